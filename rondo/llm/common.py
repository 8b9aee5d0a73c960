"""What the operators share: folds, sessions, schemas and a checkpoint that lost executors survive."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rondo.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``. A null id has a null fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Cuts the lineage by a table of Parquet files in the folder that ``spark.checkpoint.dir`` names; ``options`` are the writer's.

    Every executor reads it, so a lost one costs its running tasks only; its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Writer's options for rows of megabytes: it looks at its sizes after each.
BIG_ROWS = {"parquet.block.size": str(1 << 25), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts fits a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parts_for(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions for ``amount`` at ``each`` per partition, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each))


def _hand_back() -> None:
    """What a finished task has freed goes back to the machine; Spark keeps the worker for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere there is nothing to call
    if trim:
        trim(0)


def map_arrow_all(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with dictionaries of columns in place of record batches; columns are cast to ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            arrays = []
            for field in out:
                x = columns[field.name]
                arrays.append(x.cast(field.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, field.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=out)
            del columns, arrays, x
        _hand_back()

    return df.mapInArrow(run, spark_schema)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """The same for a function of one record batch."""
    return map_arrow_all(df, lambda batches: (columns for batch in batches for columns in f(batch)), schema)


class Counter64:
    """Counts of 64-bit keys in one task, handed on as rows (key, n) in pieces of bounded size."""

    def __init__(self, least: int = 1, limit: int = 1 << 21):
        self.least, self.limit, self.size = least, limit, 0
        self.kept: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> Iterator[dict]:
        self.kept.append(keys)
        self.size += len(keys)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if self.size:
            keys, n = np.unique(np.concatenate(self.kept), return_counts=True)
            some = n >= self.least
            self.kept, self.size = [], 0
            yield {"key": keys[some].view(np.int64), "n": n[some]}


MAX_FILTER_BITS = 28


class KeyFilter:
    """One-probe bit filter of 64-bit keys: lets all keys that it was built from pass, and a few others.

    It holds at most 2**MAX_FILTER_BITS bits, whatever the number of keys; what passes wrongly costs work only.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, keys: DataFrame, column: str, count: int) -> KeyFilter:
        bits = int(min(MAX_FILTER_BITS, max(16, math.ceil(math.log2(max(1, count) * 16)))))
        slot = F.shiftrightunsigned(F.col(column), 64 - bits)
        rows = keys.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, 0)").alias("one"), (slot.bitwiseAND(F.lit(63))).cast("int").alias("b"))
        packed = rows.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("set")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[packed.column("w").to_numpy()] = packed.column("set").to_numpy().view(np.uint64)
        return cls(words, bits)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def plus(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """The schema with these columns at its end; a column of the same name gives way."""
    new = {name for name, _ in fields}
    kept = [x for x in schema.fields if x.name not in new]
    return T.StructType(kept + [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields])


def through(batch: pa.RecordBatch, new: dict, keep=None) -> dict:
    """The batch's columns and ``new``; ``keep`` selects rows of both."""
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name not in new} | {k: pa.array(v) for k, v in new.items()}
    return columns if keep is None else {k: v.filter(pa.array(keep)) for k, v in columns.items()}


def packed(docs: DataFrame, work: Callable[[DataFrame], DataFrame], names: tuple[str, ...] = ("doc_id", "text", "n_chars")) -> DataFrame:
    """``work`` on the columns ``names`` of the documents, all others packed in one column ``rest`` meanwhile.

    So no work column can meet a column of the documents, whatever its name; ``work`` keeps ``rest``. Columns come back in their order.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    others = [c for c in docs.columns if c not in names]
    rest = F.struct(*[quoted(c) for c in others]) if others else F.lit(None).cast("boolean")
    out = work(docs.select(*[c for c in docs.columns if c in names], rest.alias("rest")))
    return out.select(*[F.col("rest").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])
