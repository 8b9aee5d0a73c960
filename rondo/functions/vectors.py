"""Vector primitives over the long and the wide form."""

from __future__ import annotations

import hashlib
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def client_norms(long: DataFrame) -> DataFrame:
    """(round, client_id, role, norm), by partial sums inside whole-stage code."""
    return long.groupBy("round", "client_id", "role").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def pairwise_distances(wide: DataFrame) -> DataFrame:
    """(round, a, b, distance) for a < b: Euclidean, not squared; joined inside a round only."""
    left = wide.select("round", F.col("client_id").alias("a"), F.col("vec").alias("va"))
    right = wide.select("round", F.col("client_id").alias("b"), F.col("vec").alias("vb"))
    gap = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return left.join(right, "round").where("a < b").select("round", "a", "b", F.sqrt(gap).alias("distance"))


def clip_factor(length: Column, threshold: Column | float, eps: float = 1e-6) -> Column:
    return F.least(F.lit(1.0), threshold / (length + F.lit(eps)))


def uniform(seed: str, *key: str) -> Column:
    """A number in (0, 1] from md5, the same in any engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0


def md5_uniform(seed: str, *key: object) -> float:
    """The same number for one key outside of Spark; below 1."""
    text = ":".join([seed, *map(str, key)])
    return min(int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 1, 4294967295) / 4294967297.0


def gaussian(seed: str, *key: str) -> Column:
    """A standard normal draw by Box and Muller from two such numbers."""
    return F.sqrt(-2 * F.ln(uniform(seed + "a", *key))) * F.cos(2 * F.lit(3.141592653589793) * uniform(seed + "b", *key))


def uniform_sql(seed: str, *key: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"{k}::VARCHAR" for k in key]])
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 1) / 4294967297.0)"


def gaussian_sql(seed: str, *key: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(seed + 'a', *key)})) * cos(2 * 3.141592653589793 * {uniform_sql(seed + 'b', *key)}))"


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def count_or_share(value: float, total: int) -> int:
    """A number of 1 or more is a count, a smaller one a share."""
    return int(value) if value >= 1 else int(value * total)


def ranked(rows: DataFrame, by: str, *keys: str, order: str = "client_id", name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(by, order)))
