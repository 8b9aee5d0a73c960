"""Local steps of a softmax regression by sums of gradients, and rounds of them with any aggregator.

The weights are a (classes x (features + 1)) matrix, flattened by class, the bias last: bounded by the model.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondo.functions import vectors as V
from rondo.operators.partitioners import shuffled, stratified_sample
from rondo.sources.shared import written


def learning_rate(base: float, round_: int, schedule: str = "constant", rounds: int = 100) -> float:
    """The rate of a round: constant, step (halved every 80), multistep (tenths at half and three quarters), exponential, cosine."""
    return {
        "constant": base,
        "step": base * 0.5 ** (round_ // 80),
        "multistep": base * 0.1 ** ((round_ >= rounds // 2) + (round_ >= rounds * 3 // 4)),
        "exponential": base * 0.9**round_,
        "cosine": base * (1 + math.cos(math.pi * round_ / rounds)) / 2,
    }[schedule]


def scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.column_stack([features, np.ones(len(features))]) @ weights.T


def _batch_of(assigned: DataFrame, batch: int, turn: int) -> DataFrame:
    """The rows of each client's turn: ``batch`` of them in shuffled order from where the turn before ended, around the end of its rows.

    Places come from parts of the shuffled order, so no task sorts all rows of a client.
    """
    order = shuffled(assigned.select("sample_id", F.col("client_id").alias("label")), "loader").select("sample_id", F.col("label").alias("client_id"), "rank", "n")
    rows = assigned.join(order, ["client_id", "sample_id"])
    return rows.where(F.pmod(F.col("rank") - 1 - F.lit(turn * batch), F.col("n")) < batch).drop("rank", "n")


#: Rows of a client and model, about, in one group of ``_gradients``.
_GROUP_ROWS = 20_000


def _gradients(rows: DataFrame, models: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(client_id, gradient): the mean gradient of the softmax regression over each client's rows, at its own weights (client_id, weights).

    A client's rows are dealt into slices, each met by the client's model once; the slices' sums meet by client and coordinate.
    """
    sizes = rows.groupBy("client_id").agg(F.count("*").alias("rows"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / _GROUP_ROWS)).alias("slices")
    owned = sizes.select("client_id", slices)
    dealt = rows.select("client_id", "sample_id", "label", "features").join(owned, "client_id").withColumn("slice", F.pmod(F.xxhash64("sample_id"), "slices")).drop("slices", "sample_id")
    copies = models.select("client_id", "weights").join(owned, "client_id").select(F.col("client_id").alias("owner"), "weights", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("part"))

    def run(key: tuple, own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"client_id": [], "rows": [], "vec": []})
        x, y = np.stack(own["features"].to_numpy()), own["label"].to_numpy()
        z = scores(x, np.asarray(model["weights"].iloc[0]).reshape(shape))
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        return pd.DataFrame({"client_id": [key[0]], "rows": [len(x)], "vec": [(p.T @ np.column_stack([x, np.ones(len(x))])).reshape(-1).tolist()]})

    parts = dealt.groupBy("client_id", "slice").cogroup(copies.groupBy("owner", "part")).applyInPandas(run, "client_id int, rows long, vec array<double>")
    cells = parts.select("client_id", "rows", F.posexplode("vec").alias("coord", "value"))
    sums = cells.groupBy("client_id", "coord").agg((F.sum("value") / F.sum("rows")).alias("value"))
    wide = sums.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("coord", "value"))).alias("cells"))
    return wide.select("client_id", F.transform("cells", lambda x: x["value"]).alias("gradient"))


def one_row(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """(weights): a model as a table of one row."""
    return spark.createDataFrame([(weights.reshape(-1).tolist(),)], "weights array<double>")


def local_updates(assigned: DataFrame, weights: np.ndarray | DataFrame, rate: float, classes: int = 10, batch: int = 0, round_: int = 0, epochs: int = 1, momentum: float = 0.0, velocity: DataFrame | None = None) -> DataFrame:
    """(round, client_id, role, vec, velocity): each client's way from ``weights`` in ``epochs`` steps on its rows, or a new batch of them a step.

    ``assigned`` has (client_id, sample_id, label, features), ``weights`` is the model, or a row of it. With ``momentum`` a step goes
    by the velocity, momentum times the one before plus the gradient; that of the round before is handed in as ``velocity``
    (client_id, velocity), zero without. The clients' models are tables, written between epochs.
    """
    spark = assigned.sparkSession
    begin = weights if isinstance(weights, DataFrame) else one_row(spark, weights)
    width = len(begin.head()["weights"]) // classes
    state = assigned.select("client_id").distinct().join(F.broadcast(begin))  # one row: the model
    if velocity is not None:
        state = state.join(velocity.select("client_id", "velocity"), "client_id", "left")
    zero = F.transform("weights", lambda x: x * 0.0)
    state = state.withColumn("velocity", F.coalesce("velocity", zero) if velocity is not None else zero).withColumn("start", F.col("weights"))
    for epoch in range(epochs):
        rows = _batch_of(assigned, batch, round_ * epochs + epoch) if batch else assigned
        state = state.join(_gradients(rows, state, (classes, width)), "client_id")
        state = state.withColumn("velocity", F.zip_with("velocity", "gradient", lambda v, g: momentum * v + g)).drop("gradient")
        state = state.withColumn("weights", F.zip_with("weights", "velocity", lambda w, v: w - rate * v))
        if epoch + 1 < epochs:
            state = written(state)
    way = F.zip_with("weights", "start", lambda w, s: w - s)
    return state.select(F.lit(round_).alias("round"), "client_id", F.lit("benign").alias("role"), way.alias("vec"), "velocity")


def root_updates(samples: DataFrame, models: DataFrame, rate: float, size: int = 100, threshold: int = 5) -> DataFrame:
    """(round, vec): the step of a root client at the model (round, model) of each round, by a stratified sample of ``size`` rows at most.

    The root learns a logistic regression of ``label >= threshold`` on the features; a step is ``rate`` times its mean gradient, downhill.
    """
    chosen = stratified_sample(samples, size).select("sample_id")
    rows = samples.join(chosen, "sample_id").select("features", (F.col("label") >= threshold).cast("double").alias("y"))
    root = F.broadcast(rows.agg(F.collect_list(F.struct("features", "y")).alias("root")))  # one row of ``size`` samples at most
    n = F.size("root")
    gaps = F.transform("root", lambda s: F.struct(s["features"].alias("x"), (1 / (1 + F.exp(-V.dot("model", s["features"]))) - s["y"]).alias("gap")))
    zero = F.transform("model", lambda v: v * 0.0)
    sums = F.aggregate(gaps, zero, lambda a, s: F.zip_with(a, s["x"], lambda v, x: v + s["gap"] * x))
    return models.join(root).where(n > 0).select("round", F.transform(sums, lambda v: -rate * v / n).alias("vec"))


def evaluated(samples: DataFrame, weights: np.ndarray | DataFrame, classes: int = 10) -> DataFrame:
    """(sample_id, label, pred, loss) of samples at a model, a one-row table that is joined; no literal of the model's size is in the plan."""
    model = weights if isinstance(weights, DataFrame) else one_row(samples.sparkSession, weights)
    classes = classes if isinstance(weights, DataFrame) else len(weights)
    width = F.size("features") + 1
    row = lambda c: F.slice("weights", c * width + 1, width)
    full = F.concat("features", F.array(F.lit(1.0)))
    out = samples.join(F.broadcast(model)).withColumn("z", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: V.dot(full, row(c))))
    top = F.array_max("z")
    total = F.aggregate(F.transform("z", lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)
    return out.select("sample_id", "label", (F.array_position("z", top) - 1).cast("int").alias("pred"), (F.ln(total) + top - F.get("z", F.col("label"))).alias("loss"))


def train(assigned: DataFrame, aggregate: Callable[[DataFrame], DataFrame], rounds: int, rate: float, classes: int, features: int, attack: Callable[[DataFrame], DataFrame] | None = None, momentum: float = 0.0, epochs: int = 1, batch: int = 0) -> DataFrame:
    """(weights): the model after rounds of local steps, an optional perturbation and one aggregation; models are tables, written once a round."""
    spark = assigned.sparkSession
    model, velocity = one_row(spark, np.zeros((classes, features + 1))), None
    for k in range(rounds):
        updates = written(local_updates(assigned, model, learning_rate(rate, k), classes, batch, k, epochs, momentum, velocity))
        velocity = updates.select("client_id", "velocity")
        own = updates.drop("velocity")
        step = aggregate(attack(own) if attack else own)
        wide = step.agg(F.array_sort(F.collect_list(F.struct("coord", "value"))).alias("cells"))  # one model
        moved = F.zip_with("weights", F.transform("cells", lambda x: x["value"]), lambda w, s: w + s)
        model = written(model.join(F.broadcast(wide)).select(moved.alias("weights")))
    return model
