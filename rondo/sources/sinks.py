"""Sinks and the sources that read them back: run logs as text, tables kept for later runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from rondo.operators import metrics


def write_lines(lines: DataFrame, path: str) -> None:
    """A text file of (line) in place of what stands there."""
    lines.select("line").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rounds of a run log."""
    return metrics.parsed_log(read_lines(spark, path))


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made and written where there is none, so that later runs read the same assignment."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
