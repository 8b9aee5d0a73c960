"""Robust aggregation: each takes wide updates (round, client_id, role, vec) and gives (round, coord, value).

Column reductions run on the long form, so partial sums are made before the shuffle; distances inside a round
on the wide form. Ties go to the lowest client id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.functions import vectors as V
from rondo.sources.fixtures import to_long

AGGREGATORS: dict[str, Callable[..., DataFrame]] = {}


def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    AGGREGATORS[f.__name__] = f
    return f


def _column_mean(long: DataFrame, value="value") -> DataFrame:
    return long.groupBy("round", "coord").agg(F.avg(value).alias("value"))


@register
def mean(updates: DataFrame) -> DataFrame:
    return _column_mean(to_long(updates))


@register
def mean_norm(updates: DataFrame, f: int = 10, eps: float = 1e-7) -> DataFrame:
    """Norms are capped at the mean of the n - f smallest, then averaged."""
    long = to_long(updates)
    norms = V.ranked(V.client_norms(long), "norm", "round")
    n = F.count("*").over(Window.partitionBy("round"))
    kept = F.col("n") - F.greatest(F.lit(0), F.least(F.lit(f), F.col("n") - 1))
    norms = norms.withColumn("n", n)
    cap = norms.groupBy("round").agg(F.avg(F.when(F.col("rank") <= kept, F.col("norm"))).alias("cap"))
    scale = norms.join(cap, "round").select("round", "client_id", (F.least("norm", "cap") / (F.col("norm") + eps)).alias("scale"))
    return _column_mean(long.join(scale, ["round", "client_id"]), F.col("value") * F.col("scale"))


@register
def median(updates: DataFrame, interpolate: bool = False) -> DataFrame:
    """The lower of the two middle values, or their mean."""
    pick = F.median("value") if interpolate else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)")
    return to_long(updates).groupBy("round", "coord").agg(pick.alias("value"))


@register
def trimmed_mean(updates: DataFrame, beta: float = 0.1) -> DataFrame:
    """int(beta n) values are dropped at either end of each column."""
    if not 0 <= beta < 0.5:
        raise ValueError("beta must leave rows to average")
    ranked = V.ranked(to_long(updates), "value", "round", "coord").withColumn("n", F.count("*").over(Window.partitionBy("round", "coord")))
    k = F.floor(F.lit(beta) * F.col("n"))
    return _column_mean(ranked.where((F.col("rank") > k) & (F.col("rank") <= F.col("n") - k)))


def krum_scores(updates: DataFrame, f: int = 10, clients: int | None = None) -> DataFrame:
    """(round, client_id, score): the sum of the n - f - 1 smallest distances to others.

    n is ``clients``, those of a run, also in a round to which fewer came; without it, those of the round.
    """
    half = V.pairwise_distances(updates)
    both = half.select("round", F.col("a").alias("client_id"), F.col("b").alias("other"), "distance").unionByName(half.select("round", F.col("b").alias("client_id"), F.col("a").alias("other"), "distance"))
    own = Window.partitionBy("round", "client_id")
    ranked = both.withColumn("rank", F.row_number().over(own.orderBy("distance", "other"))).withColumn("n", F.count("*").over(own) + 1 if clients is None else F.lit(clients))
    return ranked.groupBy("round", "client_id").agg(F.sum(F.when(F.col("rank") <= F.col("n") - f - 1, F.col("distance")).otherwise(0.0)).alias("score"))


@register
def krum(updates: DataFrame, f: int = 10, clients: int | None = None) -> DataFrame:
    best = krum_scores(updates, f, clients).groupBy("round").agg(F.min_by("client_id", F.struct("score", "client_id")).alias("client_id"))
    return to_long(updates.join(best, ["round", "client_id"])).select("round", "coord", "value")


@register
def multi_krum(updates: DataFrame, f: int = 10, share: float = 0.2, clients: int | None = None) -> DataFrame:
    """The mean of the int(n share) clients of lowest score; a round without as many as one gives an error. n is that of ``krum_scores``."""
    n = F.count("*").over(Window.partitionBy("round")) if clients is None else F.lit(clients)
    m = F.floor(n * F.lit(share))
    m = F.when(m < 1, F.raise_error(F.lit("the share selects no client"))).otherwise(m)
    picked = V.ranked(krum_scores(updates, f, clients), "score", "round").withColumn("m", m).where("rank <= m")
    return mean(updates.join(picked.select("round", "client_id"), ["round", "client_id"]))


@register
def rfa(updates: DataFrame, iterations: int = 3, eps: float = 1e-6) -> DataFrame:
    """Smoothed Weiszfeld steps towards the geometric median, from zero."""
    long = to_long(updates)
    now = None
    for _ in range(iterations):
        gap = F.col("value") if now is None else F.col("value") - F.col("v")
        rows = long if now is None else long.join(now, ["round", "coord"])
        weight = rows.groupBy("round", "client_id").agg((1 / F.greatest(F.sqrt(F.sum(gap * gap)), F.lit(eps))).alias("w"))
        now = long.join(weight, ["round", "client_id"]).groupBy("round", "coord").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("v"))
    return now.withColumnRenamed("v", "value")


@register
def norm_clipping(updates: DataFrame, threshold: float = 3.0, noise: float = 0.0) -> DataFrame:
    long = to_long(updates)
    scale = V.client_norms(long).select("round", "client_id", V.clip_factor(F.col("norm"), F.lit(threshold)).alias("scale"))
    value = F.col("value") * F.col("scale")
    if noise:
        value = value + noise * V.gaussian("clip", "round", "client_id", "coord")
    return _column_mean(long.join(scale, ["round", "client_id"]), value)


@register
def crfl(updates: DataFrame, threshold: float = 3.0, noise: float = 0.001) -> DataFrame:
    """The mean, clipped as a whole, with noise always."""
    rows = mean(updates)
    length = rows.groupBy("round").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    scale = V.clip_factor(F.col("norm"), F.lit(threshold), 1e-10)
    return rows.join(length, "round").select("round", "coord", (F.col("value") * scale + noise * V.gaussian("crfl", "round", "coord")).alias("value"))


@register
def centered_clipping(updates: DataFrame, tau: float = 100.0, centre: DataFrame | None = None) -> DataFrame:
    """One step: the centre (zero at first) plus the mean of the clipped differences from it."""
    long = to_long(updates)
    long = long.withColumn("m", F.lit(0.0)) if centre is None else long.join(centre.select("coord", F.col("value").alias("m")), "coord")
    long = long.withColumn("gap", F.col("value") - F.col("m"))
    length = long.groupBy("round", "client_id").agg(F.sqrt(F.sum(F.col("gap") * F.col("gap"))).alias("norm"))
    rows = long.join(length, ["round", "client_id"])
    return rows.groupBy("round", "coord").agg((F.first("m") + F.avg(F.col("gap") * V.clip_factor(F.col("norm"), F.lit(tau), 1e-12))).alias("value"))


@register
def bucketing(updates: DataFrame, size: int = 2, f: int = 10, inner: str = "krum", clients: int | None = None) -> DataFrame:
    """Clients in md5 order, the means of consecutive buckets, then another aggregator over the buckets.

    ``clients``, those of a run, give Krum the number of buckets, also in a round to which fewer came.
    """
    order = F.row_number().over(Window.partitionBy("round").orderBy(V.uniform("bucket", "round", "client_id"), "client_id"))
    dealt = updates.withColumn("bucket", F.floor((order - 1) / size).cast("int"))
    sums = F.reduce("vecs", F.transform(F.get("vecs", F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    vecs = dealt.groupBy("round", F.col("bucket").alias("client_id")).agg(F.collect_list("vec").alias("vecs"))  # ``size`` updates
    wide = vecs.select("round", "client_id", F.lit("bucket").alias("role"), F.transform(sums, lambda x: x / F.size("vecs")).alias("vec"))
    return krum(wide, f, None if clients is None else -(-clients // size)) if inner == "krum" else AGGREGATORS[inner](wide)


@register
def fl_trust(updates: DataFrame, root: DataFrame) -> DataFrame:
    """Trust is the cosine with the round's root update (round, vec), cut at 0; updates are rescaled to the root's length.

    A round without a root update gives nothing.
    """
    rows = updates.join(root.select("round", F.col("vec").alias("root")), "round").withColumn("norm", V.norm("vec")).withColumn("root_norm", V.norm("root"))
    size = F.col("norm") * F.col("root_norm")
    trust = F.when(size > 0, F.greatest(F.lit(0.0), V.dot("vec", "root") / size)).otherwise(0.0)
    rows = rows.withColumn("trust", trust).withColumn("total", F.sum("trust").over(Window.partitionBy("round"))).withColumn("n", F.count("*").over(Window.partitionBy("round")))
    weight = F.when(F.col("total") > 1e-9, F.col("trust") / F.col("total")).otherwise(1 / F.col("n")) * F.col("root_norm") / (F.col("norm") + 1e-9)
    cells = rows.select("round", weight.alias("w"), F.posexplode("vec").alias("coord", "value"))
    return cells.groupBy("round", "coord").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
