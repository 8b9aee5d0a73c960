"""Numeric perturbations of client updates, to score the aggregators with; attackers' rows are replaced."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.functions import vectors as V
from rondo.sources.fixtures import to_long


def _replaced(long: DataFrame, value: Column) -> DataFrame:
    return long.withColumn("value", F.when(F.col("role") == "attacker", value).otherwise(F.col("value")))


def sign_flip(updates: DataFrame) -> DataFrame:
    return _replaced(to_long(updates), -F.col("value"))


def gaussian_noise(updates: DataFrame, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    return _replaced(to_long(updates), mean + sd * V.gaussian("noise", "round", "client_id", "coord"))


def _benign(long: DataFrame) -> DataFrame:
    return long.where("role = 'benign'").groupBy("round", "coord").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))


def inner_product(updates: DataFrame, scale: float = 0.1) -> DataFrame:
    """The benign mean, turned round and scaled."""
    long = to_long(updates)
    return _replaced(long.join(_benign(long), ["round", "coord"]), -scale * F.col("mu")).drop("mu", "sd")


def little_is_enough(updates: DataFrame, z: float | None = None, clients: int | None = None, f: int = 10) -> DataFrame:
    """The benign mean moved by z deviations, z the quantile that enough benign clients lie beyond.

    With ``clients``, those of a run, of whom ``f`` attack, z is the same in a round to which fewer came.
    """
    long = to_long(updates)
    if z is None and clients is not None:
        z = _quantile(clients, f)
    if z is None:
        counts = updates.groupBy("round").agg(F.count("*").alias("clients"), F.count_if(F.col("role") == "attacker").alias("f"))
        sizes = [(r.clients, r.f) for r in counts.select("clients", "f").distinct().collect()]  # a row for each size of a round
        by = F.create_map(*[F.lit(x) for n, f in sizes if n > f for x in (f"{n},{f}", _quantile(n, f))])
        z_of = counts.select("round", F.get(F.array(F.element_at(by, F.concat_ws(",", "clients", "f"))), 0).alias("z")) if sizes else counts.select("round", F.lit(0.0).alias("z"))
        long = long.join(F.broadcast(z_of), "round")  # a row a round
    else:
        long = long.withColumn("z", F.lit(z))
    return _replaced(long.join(_benign(long), ["round", "coord"]), F.col("mu") + F.col("z") * F.col("sd")).drop("mu", "sd", "z")


def _quantile(clients: int, f: int) -> float:
    share = (clients - f - (clients // 2 + 1 - f)) / (clients - f)
    return V.normal_quantile(share) if 0 < share < 1 else 0.0


def mimic(updates: DataFrame, choice: int = 0) -> DataFrame:
    """Attackers copy one client; 0 is an attacker itself."""
    long = to_long(updates)
    chosen = long.where(F.col("client_id") == choice).select("round", "coord", F.col("value").alias("copied"))
    return _replaced(long.join(chosen, ["round", "coord"]), F.col("copied")).drop("copied")


def scaled(updates: DataFrame, scale: float = 50.0) -> DataFrame:
    return _replaced(to_long(updates), scale * F.col("value"))


def least_moved(updates: DataFrame, share: float = 0.1, bound: float = 0.2) -> DataFrame:
    """Attackers keep the k coordinates of smallest absolute value, of equal ones the first, and are clipped to a norm."""
    rows = updates.withColumn("k", F.greatest(F.lit(1), F.floor(F.size("vec") * F.lit(share))).cast("int"))
    rows = rows.withColumn("cells", F.array_sort(F.transform("vec", lambda x, i: F.struct(F.abs(x).alias("size"), i.alias("coord"), x.alias("value")))))
    kept = F.transform(F.slice("cells", F.lit(1), F.col("k")), lambda c: c["size"])
    rows = rows.withColumn("factor", V.clip_factor(V.norm(kept), F.lit(bound)))
    cells = rows.select("round", "client_id", "role", "k", "factor", F.posexplode("cells").alias("at", "c")).select("*", "c.coord", "c.value")
    return _replaced(cells, F.when(F.col("at") < F.col("k"), F.col("value") * F.col("factor")).otherwise(0.0)).select("round", "client_id", "role", "coord", "value")


def ball_projection(updates: DataFrame, eps: float = 0.25) -> DataFrame:
    """Attackers' updates brought into an l2 ball."""
    factor = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(eps), V.norm("vec"))), F.lit(1.0))
    cells = updates.withColumn("factor", factor).select("round", "client_id", "role", "factor", F.posexplode("vec").alias("coord", "value"))
    return _replaced(cells, F.col("value") * F.col("factor")).drop("factor")


def box_projection(updates: DataFrame, eps: float = 0.25) -> DataFrame:
    """Attackers' updates brought into a box: each value into [-eps, eps]."""
    return _replaced(to_long(updates), F.greatest(F.lit(-eps), F.least(F.lit(eps), F.col("value"))))


def boosted(updates: DataFrame, boost: float = 10.0) -> DataFrame:
    """``pre + boost (post - pre)``, pre the client's update of the round before (zero at first)."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("client_id", "coord").orderBy("round")), F.lit(0.0))
    rows = to_long(updates).withColumn("before", before)
    return _replaced(rows, F.col("before") + boost * (F.col("value") - F.col("before"))).drop("before")


def sign_alignment(updates: DataFrame) -> DataFrame:
    """(round, client_id, aligned): coordinates whose sign is that of a fixed random vector."""
    fixed = F.when(V.uniform("sign", "coord") > 0.5, 1.0).otherwise(-1.0)
    return to_long(updates).groupBy("round", "client_id").agg(F.count_if(F.signum("value") == fixed).cast("long").alias("aligned"))


def _sign(*key: str) -> Column:
    """A fixed random sign."""
    return F.when(V.uniform("sign", *key) > 0.5, 1.0).otherwise(-1.0)


def binomial_bound(models: DataFrame, level: float = 0.99) -> DataFrame:
    """One row (bound): the least k with P(X <= k) >= ``level``, X the heads of as many fair coins as the model has coordinates.

    The terms' ratios (d - k + 1) / k are multiplied up within ten deviations of the mean, beyond which there are 1e-23 of all:
    some 10 sqrt(d) rows.
    """
    size = models.agg(F.count_distinct("coord").alias("d"))
    far = F.ceil(5 * F.sqrt("d"))
    rows = size.select("d", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("d") / 2) - far), F.least("d", F.ceil(F.col("d") / 2) + far))).alias("k"))
    running = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("k").over(Window.partitionBy())
    rows = rows.withColumn("log", F.sum(F.when(F.col("k") > first, F.ln((F.col("d") - F.col("k") + 1) / F.col("k"))).otherwise(0.0)).over(running))
    rows = rows.withColumn("weight", F.exp(F.col("log") - F.max("log").over(Window.partitionBy())))
    rows = rows.withColumn("below", F.sum("weight").over(running) / F.sum("weight").over(Window.partitionBy()))
    return rows.where(F.col("below") >= level).agg(F.min("k").alias("bound"))


def residual_scale(models: DataFrame, every: int = 50, factor: float = 8.0, decay: float = 0.7, least: float = 0.5, level: float = 0.99) -> DataFrame:
    """(round, aligned, bound, factor, history, length) of a perturbation along fixed signs, from the models (round, coord, value) that rounds began with.

    ``history`` is the length of the model's last move. Each ``every`` rounds the move since the snapshot ``every`` rounds before (the
    first model if there is none) is compared with the fixed signs: ``aligned`` coordinates agree. With fewer than ``bound`` the
    factor decays, unless it would fall below ``least``. ``length`` is factor times history. No row without a model before.
    """
    first = models.agg(F.min("round").alias("first"))  # one row
    moves = models.withColumn("before", F.lag("value").over(Window.partitionBy("coord").orderBy("round")))
    history = moves.where("before IS NOT NULL").groupBy("round").agg(F.sqrt(F.sum((F.col("value") - F.col("before")) * (F.col("value") - F.col("before")))).alias("history"))
    checked = models.where(F.col("round") % every == 0).join(F.broadcast(first))
    checked = checked.select("round", "coord", "value", F.greatest("first", F.col("round") - every).alias("then")).where("round > then")
    snapshot = models.select(F.col("round").alias("then"), "coord", F.col("value").alias("kept"))
    moved = checked.join(snapshot, ["then", "coord"]).withColumn("move", F.col("value") - F.col("kept"))
    agrees = F.signum(F.when(F.col("move") == 0, F.col("value")).otherwise(F.col("move"))) == _sign("coord")
    aligned = moved.groupBy("round").agg(F.count_if(agrees).alias("aligned"))
    rows = history.join(aligned, "round", "left").join(F.broadcast(binomial_bound(models, level)))
    fails = F.count_if(F.col("aligned") < F.col("bound")).over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0))  # a row a round
    most = 0
    while factor * decay ** (most + 1) >= least:
        most += 1
    rows = rows.withColumn("factor", factor * F.pow(F.lit(decay), F.least(fails, F.lit(most))))
    return rows.select("round", "aligned", "bound", "factor", "history", (F.col("factor") * F.col("history")).alias("length"))


def residual(updates: DataFrame, models: DataFrame, **scale: Any) -> DataFrame:
    """(round, client_id, role, coord, value): attackers send the residual of the model's last move along the fixed signs.

    The residual is the move less the attackers' mean update of the round before, stretched to the move's length; its
    absolute values, with the fixed signs, are scaled to length 1 and then to ``residual_scale``. Rounds without a model and an
    update before stay as they are.
    """
    size = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(Window.partitionBy("round")))
    moves = models.withColumn("move", F.col("value") - F.lag("value").over(Window.partitionBy("coord").orderBy("round"))).where("move IS NOT NULL").drop("value")
    sent = to_long(updates.where("role = 'attacker'")).groupBy((F.col("round") + 1).alias("round"), "coord").agg(F.avg("value").alias("sent"))
    rows = moves.join(sent, ["round", "coord"]).withColumn("gap", F.col("move") - F.col("sent") * (size("move") / (size("sent") + 1e-9)))
    lengths = residual_scale(models, **scale).select("round", "length")
    rows = rows.withColumn("unit", F.abs("gap") * _sign("coord") / (size("gap") + 1e-9)).join(lengths, "round")
    new = rows.select("round", "coord", (F.col("unit") * F.col("length")).alias("new"))
    return _replaced(to_long(updates).join(new, ["round", "coord"], "left"), F.coalesce("new", "value")).drop("new")


def scheduled(rows: DataFrame, kind: str, start: int = 0, frequency: int = 1) -> DataFrame:
    """The rounds in which an attack is on."""
    on = {"continuous": F.col("round") >= start, "single": F.col("round") == start, "frequency": F.col("round") % frequency == 0}
    return rows.where(on[kind])


#: What an attack poisons, fixed values: (name, attributes); ``categories`` takes any table of these columns.
ATTACKS = [
    ("label_flipping", ["data_poisoning"]), ("trigger_patch", ["data_poisoning"]), ("trigger_strips", ["data_poisoning"]),
    ("scaling", ["data_poisoning", "model_poisoning"]), ("ball_projection", ["data_poisoning", "model_poisoning"]), ("least_moved", ["data_poisoning", "model_poisoning"]),
    ("gaussian_noise", ["model_poisoning"]), ("sign_flip", ["model_poisoning"]), ("inner_product", ["model_poisoning"]), ("little_is_enough", ["model_poisoning"]), ("mimic", ["model_poisoning"]),
]


def categories(attacks: DataFrame) -> DataFrame:
    """(category, name) of attacks (name, attributes): data, hybrid (data and model) and model (no data) attacks; a hybrid one is a data attack too."""
    has = lambda x: F.array_contains("attributes", f"{x}_poisoning")
    kinds = F.array(F.when(has("data"), F.lit("data")), F.when(has("data") & has("model"), F.lit("hybrid")), F.when(~has("data"), F.lit("model")))
    return attacks.select(F.explode(F.array_compact(kinds)).alias("category"), "name")
