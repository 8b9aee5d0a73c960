"""Labelled samples from folders and delimited files, as (path or id, label, features)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.operators.partitioners import shuffled
from rondo.sources import png
from rondo.sources.sinks import kept


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, class, label, content): a file's class is its folder, labels number the classes in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    rows = files.select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("class"), "content")
    names = rows.select("class").distinct().withColumn("label", F.row_number().over(Window.partitionBy().orderBy("class")) - 1)  # a row a class
    return rows.join(F.broadcast(names), "class").select("path", "class", "label", "content")


def decoded(rows: DataFrame, strict: bool = True) -> DataFrame:
    """The rows with (height, width, channels, features) in place of ``content``: bytes over 255 by row, pixel and channel.

    Files are decoded in Arrow batches. One that is no image is an error, or has null columns if not ``strict``; a null content has null columns.
    """
    kept_columns = [c for c in rows.columns if c not in ("content", "height", "width", "channels", "features")]
    types = dict(rows.dtypes)

    def image(data: bytes | None) -> np.ndarray | None:
        if data is None:
            return None
        try:
            return png.decode(data)
        except Exception:
            if strict:
                raise
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):  # so many images of numbers at a time
                part = batch.slice(k, 64)
                found = [image(x.as_py()) for x in part.column(len(kept_columns))]
                size = [pa.array([None if x is None else x.shape[i] for x in found], pa.int32()) for i in range(3)]
                features = pa.array([None if x is None else x.reshape(-1) / 255.0 for x in found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *size, features], [*kept_columns, "height", "width", "channels", "features"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept_columns), "height int, width int, channels int, features array<double>"])
    return rows.select(*kept_columns, "content").mapInArrow(run, schema)


def encoded(rows: DataFrame, height: int, width: int, channels: int = 1) -> DataFrame:
    """The rows with ``content``, an image file of ``features`` in 0 to 1 by row, pixel and channel, in their place."""
    kept_columns = [c for c in rows.columns if c != "features"]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = [np.floor(np.clip(np.array(x.as_py()), 0, 1) * 255 + 0.5).astype(np.uint8) for x in batch.column(len(kept_columns))]
            files = pa.array([png.encode(x.reshape(height, width, channels)) for x in pixels], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], files], [*kept_columns, "content"])

    return rows.select(*kept_columns, "features").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept_columns), "content binary"]))


def image_folder(spark: SparkSession, path: str, cache: str | None = None, pattern: str = "*", strict: bool = True) -> DataFrame:
    """(path, class, label, height, width, channels, features) of a folder of image files; with ``cache`` decoded once and read from there later."""
    make = lambda: decoded(folder(spark, path, pattern), strict)
    return kept(spark, cache, make) if cache else make()


def stratified_split(rows: DataFrame, share: float = 0.8, key: str = "path", seed: str = "42") -> DataFrame:
    """Adds ``part``: int(n share) rows of each class in md5 order train, the others test."""
    order = shuffled(rows.select(F.col(key).alias("sample_id"), "label"), seed).select(F.col("sample_id").alias(key), "rank", "n")
    return rows.join(order, key).withColumn("part", F.when(F.col("rank") <= F.floor(F.col("n") * share), "train").otherwise("test")).drop("rank", "n")


def listed(spark: SparkSession, names: str, images: str) -> DataFrame:
    """(file, wnid, label): images of a tab-separated table labelled by the place of their name in a list."""
    order = spark.read.text(names, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\\s+")).alias("label", "wnid"))
    table = spark.read.csv(images, sep="\t").select(F.col("_c0").alias("file"), F.col("_c1").alias("wnid"))
    return table.join(F.broadcast(order), "wnid").select("file", "wnid", "label")  # a row a class


def one_hot_label(columns: list[Column]) -> Column:
    values = F.array(*columns)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``sample_id``, the number of a row from 1 on: its place in its partition, and the rows of the partitions before."""
    at = F.monotonically_increasing_id()
    rows = rows.withColumn("at", at).withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("sample_id", F.col("before") + F.col("place") + 1).drop("at", "part", "place", "before")


def delimited(spark: SparkSession, features: str, labels: str, size: int, classes: int) -> DataFrame:
    """(sample_id, label, features) from two files of numbers, one line a sample, labels one-hot; joined by line number."""

    def lines(path: str, width: int, name: str) -> DataFrame:
        rows = spark.read.csv(path, schema=", ".join(f"c{k} double" for k in range(width)))
        return _numbered(rows.select(F.array(*[F.col(f"c{k}") for k in range(width)]).alias(name)))

    both = lines(features, size, "features").join(lines(labels, classes, "hot"), "sample_id")
    return both.select("sample_id", (F.array_position("hot", F.array_max("hot")) - 1).cast("int").alias("label"), "features")
