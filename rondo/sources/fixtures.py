"""The logical tables of the engine, derived from the driver's tables; see FIXTURES.md.

A round is 50 consecutive vectors of ``embeddings``; clients 0 to 9 of a round are attackers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLIENTS = 50
ATTACKERS = 10
DIM = 64
CLASSES = 4
#: The layers of a vector of DIM coordinates: (ord, layer, start, len, ndim, kind).
LAYOUT = [(0, "fc1.weight", 0, 32, 2, "weight"), (1, "fc1.bias", 32, 4, 1, "bias"), (2, "fc2.weight", 36, 24, 2, "weight"), (3, "fc2.bias", 60, 4, 1, "bias")]


#: The shapes of its layers: (layer, start, shape).
SHAPES = [("fc1.weight", 0, (4, 8)), ("fc1.bias", 32, (4,)), ("fc2.weight", 36, (4, 6)), ("fc2.bias", 60, (4,))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round, client_id, role, vec): one row a client and round, values widened to double at the scan."""
    rows = table(spark, sf_dir, "embeddings")
    client = (F.col("vec_id") % CLIENTS).cast("int")
    return rows.select(
        F.floor(F.col("vec_id") / CLIENTS).cast("int").alias("round"), client.alias("client_id"),
        F.when(client < ATTACKERS, "attacker").otherwise("benign").alias("role"), F.col("embedding").cast("array<double>").alias("vec"),
    )


def to_long(wide: DataFrame) -> DataFrame:
    """(round, client_id, role, coord, value)."""
    return wide.select("round", "client_id", "role", F.posexplode("vec").alias("coord", "value"))


def to_wide(long: DataFrame) -> DataFrame:
    """Back to one array a client."""
    rows = long.groupBy("round", "client_id", "role").agg(F.array_sort(F.collect_list(F.struct("coord", "value"))).alias("cells"))
    return rows.select("round", "client_id", "role", F.transform("cells", lambda x: x["value"]).alias("vec"))


def layout(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAYOUT, "ord int, layer string, start int, len int, ndim int, kind string")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round, sample_id, label, pred, loss, triggered, source_label) from a fixed linear scorer of ten classes."""
    rows = samples(spark, sf_dir)
    picked = F.slice("features", 1, 10)
    pred = (F.array_position(picked, F.array_max(picked)) - 1).cast("int")
    total = F.aggregate(picked, F.lit(0.0), lambda a, x: a + F.exp(x))
    loss = F.ln(total) - F.get(picked, F.col("label"))
    return rows.select(
        F.floor(F.col("sample_id") / CLIENTS).cast("int").alias("round"), "sample_id", "label", pred.alias("pred"), loss.alias("loss"),
        (F.col("sample_id") % 5 == 0).alias("triggered"), ((F.col("label") + 1) % 10).alias("source_label"),
    )


#: SQL of the same tables for oracles.
UPDATES_SQL = (
    "u AS (SELECT (vec_id // 50)::INTEGER AS round, (vec_id % 50)::INTEGER AS client_id, CASE WHEN vec_id % 50 < 10 THEN 'attacker' ELSE 'benign' END AS role, "
    "list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), "
    "l AS (SELECT round, client_id, role, unnest(range(64))::INTEGER AS coord, unnest(vec) AS value FROM u)"
)
