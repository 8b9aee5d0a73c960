"""Operators that look at layers, signs, similarity and trust of client updates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.functions import vectors as V
from rondo.operators.aggregators import register
from rondo.sources.fixtures import to_long


def with_layer(long: DataFrame, layout: DataFrame) -> DataFrame:
    """Adds layer, ndim and kind: a range join with a layout of a few rows."""
    table = F.broadcast(layout.select("layer", "ndim", "kind", "start", "len"))  # one row a layer of the model
    return long.join(table, (F.col("coord") >= F.col("start")) & (F.col("coord") < F.col("start") + F.col("len"))).drop("start", "len")


def nested(vec: Column | str, start: int, shape: tuple[int, ...]) -> Column:
    """A layer of a flat model as arrays in arrays of its shape, by slices: no row a coordinate."""
    flat = F.col(vec) if isinstance(vec, str) else vec
    if len(shape) == 1:
        return F.slice(flat, F.lit(start + 1), F.lit(shape[0]))

    def cut(at: Column, rest: tuple[int, ...]) -> Column:
        if len(rest) == 1:
            return F.slice(flat, at, F.lit(rest[0]))
        step = math.prod(rest[1:])
        return F.transform(F.sequence(F.lit(0), F.lit(rest[0] - 1)), lambda k: cut(at + k * step, rest[1:]))

    return cut(F.lit(start + 1), shape)


def flat(layers: list[tuple[Column | str, int]]) -> Column:
    """The flat model of its nested layers (column, depth), end to end."""
    parts = []
    for layer, depth in layers:
        own = F.col(layer) if isinstance(layer, str) else layer
        for _ in range(depth - 1):
            own = F.flatten(own)
        parts.append(own)
    return F.concat(*parts)


def restored(updates: DataFrame, shapes: list[tuple[str, int, tuple[int, ...]]]) -> DataFrame:
    """(round, client_id, role, and a nested column for each layer (name, start, shape))."""
    return updates.select("round", "client_id", "role", *[nested("vec", start, shape).alias(name) for name, start, shape in shapes])


def layer_norms(updates: DataFrame, layout: DataFrame) -> DataFrame:
    rows = with_layer(to_long(updates), layout)
    return rows.groupBy("round", "client_id", "layer").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def output_layer(updates: DataFrame, start: int = 36) -> DataFrame:
    """The last two layers: sliced from the array before it is exploded."""
    sliced = F.slice("vec", start + 1, F.size("vec") - start)
    rows = updates.select("round", "client_id", F.posexplode(sliced).alias("k", "value"))
    return rows.select("round", "client_id", (F.col("k") + start).alias("coord"), "value")


def cosine_with_last(updates: DataFrame) -> DataFrame:
    """(round, client_id, cosine) with the client's update of the round before; null without one or with a zero norm."""
    before = F.lag("vec").over(Window.partitionBy("client_id").orderBy("round"))
    rows = updates.withColumn("before", before)
    size = V.norm("vec") * V.norm("before")
    return rows.select("round", "client_id", F.when(size > 0, V.dot("vec", "before") / size).alias("cosine"))


def top_k_mask(updates: DataFrame, share: float = 0.1) -> DataFrame:
    """The coordinates of the k largest absolute values of each client; of equal ones the first."""
    k = F.greatest(F.lit(1), F.floor(F.size("vec") * F.lit(share))).cast("int")
    cells = F.transform("vec", lambda x, i: F.struct((-F.abs(x)).alias("key"), i.alias("coord"), x.alias("value")))
    rows = updates.select("round", "client_id", F.inline(F.slice(F.array_sort(cells), F.lit(1), k)))
    return rows.select("round", "client_id", "coord", "value")


def sign_features(updates: DataFrame) -> DataFrame:
    """Shares of positive, zero and negative coordinates, each over the round's largest."""
    share = lambda s: F.size(F.filter("vec", lambda x: F.signum(x) == s)) / F.size("vec")
    rows = updates.select("round", "client_id", *[share(s).alias(name) for name, s in (("pos", 1), ("zero", 0), ("neg", -1))])
    top = Window.partitionBy("round")
    return rows.select("round", "client_id", *[(F.col(c) / (F.max(c).over(top) + 1e-8)).alias(c) for c in ("pos", "zero", "neg")])


def norm_filter(updates: DataFrame, low: float = 0.1, high: float = 3.0) -> DataFrame:
    """(round, client_id, norm, kept): norm strictly between low and high times the lower median."""
    norms = updates.select("round", "client_id", V.norm("vec").alias("norm"))
    middle = norms.groupBy("round").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY norm)").alias("middle"))
    return norms.join(middle, "round").select("round", "client_id", "norm", ((F.col("norm") > low * F.col("middle")) & (F.col("norm") < high * F.col("middle"))).alias("kept"))


@register
def lasa(updates: DataFrame, layout: DataFrame, norm_bound: float = 2.0, sign_bound: float = 1.0, sparsity: float = 0.3) -> DataFrame:
    """Per layer the mean, clipped to the median norm, of the clients whose norm and sign score are near the median.

    For the two scores a client's matrices (layers of two or four dimensions) are made sparse: what is not above the k-th largest
    absolute value of all of them is zeroed. All clients count in a layer where none passes. Thresholds come from the
    wide row; the long form is made once.
    """
    matrices = layout.where("ndim IN (2, 4)").agg(F.collect_list(F.struct("start", "len")).alias("matrices"))  # one row
    rows = updates.select("round", "client_id", "vec", V.norm("vec").alias("norm")).join(F.broadcast(matrices))
    sizes = F.sort_array(F.flatten(F.transform("matrices", lambda x: F.transform(F.slice("vec", x["start"] + 1, x["len"]), F.abs))), False)
    k = F.greatest(F.lit(1), F.floor(F.size(sizes) * F.lit(1 - sparsity))).cast("int")
    rows = rows.withColumn("limit", F.coalesce(F.try_element_at(sizes, k), F.lit(-1.0)) if sparsity else F.lit(-1.0))
    middle = rows.groupBy("round").agg(F.median("norm").alias("middle"))
    rows = rows.join(middle, "round").withColumn("scale", F.least("norm", "middle") / (F.col("norm") + 1e-12))
    cells = with_layer(rows.select("round", "client_id", "scale", "limit", F.posexplode("vec").alias("coord", "value")), layout)
    cells = cells.withColumn("sparse", F.when(F.col("ndim").isin(2, 4) & (F.abs("value") <= F.col("limit")), 0.0).otherwise(F.col("value")))
    signs = F.sum(F.signum("sparse")) / (F.sum(F.abs(F.signum("sparse"))) + 1e-12)
    score = cells.groupBy("round", "layer", "client_id").agg(F.sqrt(F.sum(F.col("sparse") * F.col("sparse"))).alias("norm"), (0.5 * signs * (1 - sparsity)).alias("sign"))
    stats = score.groupBy("round", "layer").agg(*[x for c in ("norm", "sign") for x in (F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"{c}_mid"), F.stddev_pop(c).alias(f"{c}_sd"))])
    near = lambda c, bound: F.abs(F.col(c) - F.col(f"{c}_mid")) / (F.col(f"{c}_sd") + 1e-12) < bound
    score = score.join(stats, ["round", "layer"]).select("round", "layer", "client_id", (near("norm", norm_bound) & near("sign", sign_bound)).alias("good"))
    score = score.withColumn("any", F.max("good").over(Window.partitionBy("round", "layer")))
    kept = score.where(F.col("good") | ~F.col("any")).select("round", "layer", "client_id")
    return cells.join(kept, ["round", "layer", "client_id"]).groupBy("round", "coord").agg(F.avg(F.col("value") * F.col("scale")).alias("value"))


def indicative_mask(model: DataFrame, start: int = 36, classes: int = 4, width: int = 6, share: float = 0.1) -> DataFrame:
    """(round, coord): of each class the ``int(classes share)`` largest weights of the output layer of the global model (round, coord, value).

    All of them if that is none. As the mask is padded in front only, it stands at the end of the vector, past the place
    of the weights by as many coordinates as there are biases.
    """
    k = int(classes * share)
    weights = model.where(F.col("coord").between(start, start + classes * width - 1)).withColumn("class", F.floor((F.col("coord") - start) / width))
    rank = F.row_number().over(Window.partitionBy("round", "class").orderBy(F.col("value").desc(), "coord"))
    kept = weights.withColumn("rank", rank).where(F.col("rank") <= k) if k else weights
    return kept.select("round", (F.col("coord") + classes).alias("coord"))


def fools_gold_weights(updates: DataFrame, model: DataFrame, start: int = 36, classes: int = 4, width: int = 6, share: float = 0.1, eps: float = 1e-6) -> DataFrame:
    """(round, client_id, weight) from the cosine similarity of running sums of the clients' updates, on the telling coordinates.

    Similar clients weigh little; one is pardoned against another that is more like the rest than itself.
    """
    scaled = updates.select("round", "client_id", V.norm("vec").alias("norm"), "vec")
    tail = F.slice("vec", start + classes + 1, classes * width)  # only coordinates that a mask can name
    cells = scaled.select("round", "client_id", F.greatest("norm", F.lit(1.0)).alias("by"), F.posexplode(tail).alias("at", "x"))
    cells = cells.select("round", "client_id", (F.col("at") + start + classes).alias("coord"), (F.col("x") / F.col("by")).alias("value"))
    history = cells.withColumn("value", F.sum("value").over(Window.partitionBy("client_id", "coord").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))
    told = history.join(indicative_mask(model, start, classes, width, share), ["round", "coord"])
    wide = told.groupBy("round", "client_id").agg(F.array_sort(F.collect_list(F.struct("coord", "value"))).alias("cells"))
    wide = wide.select("round", "client_id", F.transform("cells", lambda x: x["value"]).alias("vec")).withColumn("norm", V.norm("vec"))
    a = wide.select("round", F.col("client_id").alias("i"), F.col("vec").alias("vi"), F.col("norm").alias("ni"))
    b = wide.select("round", F.col("client_id").alias("j"), F.col("vec").alias("vj"), F.col("norm").alias("nj"))
    size = F.col("ni") * F.col("nj")
    pairs = a.join(b, "round").where("i <> j").select("round", "i", "j", F.when(size > 0, V.dot("vi", "vj") / size).otherwise(0.0).alias("cs"))
    # a client's cosine with itself counts as 0
    pairs = pairs.withColumn("most", F.greatest(F.max("cs").over(Window.partitionBy("round", "i")), F.lit(0.0)) + eps)
    pairs = pairs.withColumn("other", F.greatest(F.max("cs").over(Window.partitionBy("round", "j")), F.lit(0.0)) + eps)
    pardoned = F.when(F.col("most") < F.col("other"), F.col("cs") * F.col("most") / F.col("other")).otherwise(F.col("cs"))
    w = pairs.groupBy("round", "i").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.max(pardoned), F.lit(0.0)))).alias("w"))
    w = w.withColumn("w", F.col("w") / (F.max("w").over(Window.partitionBy("round")) + eps)).withColumn("w", F.when(F.col("w") == 1, 0.99).otherwise(F.col("w")))
    logit = F.ln(F.col("w") / (1 - F.col("w")) + eps) + 0.5
    return w.select("round", F.col("i").alias("client_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), logit)).alias("weight"))


@register
def fools_gold(updates: DataFrame, model: DataFrame, **more) -> DataFrame:
    """The sum, not the mean, of the weighted updates, each scaled to a norm of 1 at most."""
    cells = updates.withColumn("by", F.greatest(V.norm("vec"), F.lit(1.0))).select("round", "client_id", "by", F.posexplode("vec").alias("coord", "value"))
    rows = cells.join(fools_gold_weights(updates, model, **more), ["round", "client_id"])
    return rows.groupBy("round", "coord").agg(F.sum(F.col("weight") * F.col("value") / F.col("by")).alias("value"))


def neuron_energy(updates: DataFrame, start: int = 36, classes: int = 4, width: int = 6) -> DataFrame:
    """(round, client_id, class, neup, te): a class's share of the output layer's energy, and how many pass the threshold."""
    rows = output_layer(updates, start)
    label = F.when(F.col("coord") < start + classes * width, F.floor((F.col("coord") - start) / width)).otherwise(F.col("coord") - start - classes * width)
    energy = rows.groupBy("round", "client_id", label.cast("int").alias("class")).agg(F.pow(F.sum(F.abs("value")), 2).alias("energy"))
    own = Window.partitionBy("round", "client_id")
    energy = energy.withColumn("neup", F.col("energy") / F.sum("energy").over(own)).withColumn("limit", F.greatest(F.lit(0.01), F.lit(1.0 / classes)) * F.max("neup").over(own))
    return energy.select("round", "client_id", "class", "neup", F.count_if(F.col("neup") > F.col("limit")).over(own).cast("long").alias("te"))
