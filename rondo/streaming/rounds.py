"""State across rounds with Structured Streaming: running centres, a detector, and windows over events.

Batches are kept as tables and the rounds that are whole by then are stepped together, cut into segments of consecutive rounds that run
side by side (``chained``). What goes on to the next batch are written tables, so a lost executor, a second try of a batch or a new
start of the stream repeats unfinished rounds only. Results of a bounded run are written as Parquet beside the checkpoint and read
back. State by key is in ``keyed``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rondo.sources.shared import settings, shared_folder, written


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


#: A row is late by the latest event of the batch before its own: right for a single stateful operator.
_LATE_AT_ONCE = {"spark.sql.streaming.statefulOperator.allowMultiple": "false"}


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what its source has now and gives the result table."""
    spark = stream.sparkSession
    folder = scratch(spark)
    out, schema = f"{folder}/out", stream.schema
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    with settings(spark, _LATE_AT_ONCE):
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


_RESULT = "round int, coord int, value double"


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return [x.getPath().toString() for x in found or []]


class Rounds:
    """What a stream of rounds has in its folder: the rows of each batch as they came, and tables of what was made of runs of rounds.

    A table has the number of the last round of its run. It is there when its write has ended; nothing else is state, so a
    stream that was stopped goes on from here.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder, schema

    def done(self, name: str = "out") -> list[int]:
        """The last rounds of the runs that have the table ``name``, in order."""
        return sorted(int(x.split("/last=")[-1].split("/")[0]) for x in _listed(self.spark, f"{self.folder}/{name}/last=*/_SUCCESS"))

    def keep(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/rounds/batch={batch}")

    def counts(self, batch: int | str = "*") -> DataFrame:
        """(batch, round, n) of the rows kept, of one batch or all."""
        found = _listed(self.spark, f"{self.folder}/rounds/batch={batch}")
        if not found:
            return self.spark.createDataFrame([], "batch int, round int, n long")
        return self._kept(found).groupBy("batch", "round").agg(F.count("*").alias("n"))

    def _kept(self, paths: Iterable[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/rounds").schema(self.schema).parquet(*paths)

    def rows(self, batches: Iterable[int], first: int, last: int) -> DataFrame:
        """The rows of a run of rounds, from the batches that have any."""
        kept = self._kept([f"{self.folder}/rounds/batch={k}" for k in sorted(batches)])
        return kept.where(F.col("round").between(first, last)).select(*self.schema.names)

    def table(self, name: str, *numbers: int) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{name}/last={k}" for k in numbers])

    def write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/last={number}")


#: Takes the state before a round (none at first), its clients' ids, their updates and its number; gives the state after it and its value.
Step = Callable[[Any, np.ndarray, np.ndarray, int], tuple[Any, np.ndarray]]

#: Numbers in a segment of rounds (32 MB), which one task steps; one round at least.
_SEGMENT = 1 << 22


def chained(rows: DataFrame, first: Any, step: Step, same: Callable[[Any, Any], bool]) -> DataFrame:
    """(segment, round, value, state): rounds stepped in order, those of a segment in one task; ``state``, at the end of a segment only, is pickled.

    ``rows`` are (segment, round, client_id, vec), segments from 0 without gaps; ``first`` is the state before them all. All
    segments run side by side, the later ones without a state. Each one whose state before, the end of the segment
    before it, is not the ``same`` as what it ran from is then run again from that, until there is none. A pass settles one
    more segment at least, so there are as many passes as segments at most; steps that soon forget their state need two or three.
    """

    def run(key: tuple, group: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"segment": [], "round": [], "value": [], "state": []})
        group = group.sort_values(["round", "client_id"], kind="stable")
        number, ids, m = group["round"].to_numpy(), group["client_id"].to_numpy(), np.stack(group["vec"].to_numpy())
        state, out = pickle.loads(starts["start"].iloc[0]) if len(starts) else None, []
        for at in np.split(np.arange(len(m)), np.flatnonzero(np.diff(number)) + 1):
            state, value = step(state, ids[at], m[at], int(number[at[0]]))
            out.append((key[0], number[at[0]], value, None))
        out[-1] = (*out[-1][:3], pickle.dumps(state))
        return pd.DataFrame(out, columns=["segment", "round", "value", "state"])

    def stepped(of: DataFrame, starts: DataFrame) -> DataFrame:
        return of.groupBy("segment").cogroup(starts.groupBy("segment")).applyInPandas(run, "segment int, round int, value array<double>, state binary")

    differs = F.udf(lambda a, b: b is None or not same(pickle.loads(a), pickle.loads(b)), "boolean")
    used = rows.sparkSession.createDataFrame([] if first is None else [(0, bytearray(pickle.dumps(first)))], "segment int, start binary")
    parts = written(stepped(rows, used))
    while True:
        ends = parts.where("state IS NOT NULL").select((F.col("segment") + 1).alias("segment"), F.col("state").alias("start"))
        ends = ends.join(parts.select("segment").distinct(), "segment", "left_semi")
        stale = ends.join(used.withColumnRenamed("start", "before"), "segment", "left").where(differs("start", "before")).select("segment", "start")
        stale = written(stale)  # a state a segment
        again = F.broadcast(stale.select("segment"))
        if stale.isEmpty():
            return parts
        parts = written(parts.join(again, "segment", "left_anti").unionByName(stepped(rows.join(again, "segment", "left_semi"), stale)))
        used = written(used.join(again, "segment", "left_anti").unionByName(stale))


def by_round(updates: DataFrame, step: Step, same: Callable[[Any, Any], bool], clients: int | None = None, folder: str | None = None, finish: bool = True) -> DataFrame:
    """(round, coord, value): ``step`` makes the values of each round of a stream (round, client_id, role, vec), in order; ``same`` is that of ``chained``.

    Batches are kept first, so a round may come in parts. It is stepped once it is whole: when rows of a later
    round are there, or ``clients`` of its own if that is given; with ``finish`` the end of the source makes the rest
    whole. Rows of a round that was stepped before are late and left out. With the ``folder`` of a stream that was stopped,
    the new one goes on where that ended and gives the rows of one run.
    """
    spark = updates.sparkSession
    rounds = Rounds(spark, folder or scratch(spark), updates.schema)
    seen = {(x["batch"], x["round"]): x["n"] for x in rounds.counts().collect()}  # a number a batch and round

    def advance(end: bool) -> None:
        before = rounds.done()
        waiting: dict[int, int] = {}
        for (_, k), n in seen.items():
            if not before or k > before[-1]:
                waiting[k] = waiting.get(k, 0) + n
        last, ready = max(waiting, default=0), []
        for k in sorted(waiting):
            if not (end or (k < last if clients is None else waiting[k] >= clients)):
                break  # rounds go in order
            ready.append(k)
        if not ready:
            return
        rows = rounds.rows({b for b, k in seen if ready[0] <= k <= ready[-1]}, ready[0], ready[-1]).where("vec IS NOT NULL")
        size = rows.agg(F.max(F.size("vec")).alias("d")).first()["d"] or 1
        per = max(1, _SEGMENT // (size * max(waiting[k] for k in ready)))
        turn = spark.createDataFrame(pd.DataFrame({"round": ready, "segment": np.arange(len(ready)) // per}), "round int, segment int")  # a row a round
        first = pickle.loads(rounds.table("state", before[-1]).first()["state"]) if before else None  # one state
        parts = chained(rows.join(F.broadcast(turn), "round").select("segment", "round", "client_id", "vec"), first, step, same)
        rounds.write(parts.where("state IS NOT NULL").orderBy(F.desc("round")).limit(1).select("state"), "state", ready[-1])
        rounds.write(parts.select("round", F.posexplode("value").alias("coord", "value")), "out", ready[-1])

    def batch(rows: DataFrame, number: int) -> None:
        rounds.keep(rows, number)
        for key in [x for x in seen if x[0] == number]:
            del seen[key]
        seen.update({(number, x["round"]): x["n"] for x in rounds.counts(number).collect()})
        advance(False)

    updates.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{rounds.folder}/checkpoint").foreachBatch(batch).start().awaitTermination()
    if finish:
        advance(True)
    if not rounds.done():
        return spark.createDataFrame([], _RESULT)
    return rounds.table("out", *rounds.done()).select("round", "coord", "value")


def centred_clipping(updates: DataFrame, tau: float = 100.0, **options: Any) -> DataFrame:
    """(round, coord, value) of the running centre: after each round it moves by the mean of the clipped gaps.

    The state is the centre. A step brings two centres no further apart, so those within 1e-12 of each other are taken as the same.
    ``options`` are those of ``by_round``.
    """

    def step(centre: np.ndarray | None, ids: np.ndarray, m: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        gap = m if centre is None else m - centre
        moved = (gap * np.minimum(1, tau / (np.linalg.norm(gap, axis=1) + 1e-12))[:, None]).mean(0)
        now = moved if centre is None else centre + moved
        return now, now

    return by_round(updates, step, lambda a, b: bool(np.abs(a - b).max() <= 1e-12), **options)


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows of event time (an extension).

    In append mode a window is given once it ends ``late`` before the latest event of the batches before, and rows of such a window
    are dropped; in complete mode all windows are kept and no row is late.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def event_rounds(events: DataFrame, width: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """(start, client_id, n, total): rounds as tumbling windows of event time, an update of each client in a round (an extension).

    For append mode: a round closes when an event ``late`` after its end has come, and rows for a closed round are dropped.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("client_id"))
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "client_id", "n", "total")


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream: the folder of its files, or the one file of it in ``folder``."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def curvature_product(weights: np.ndarray, gradients: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The compact L-BFGS product B v; ``weights`` and ``gradients`` hold one difference a row, the last the newest.

    B = s I - [s W' G'] M^-1 [s W; G] with M = [[s W W', L], [L', -D]], D the diagonal and L the strictly lower
    part of W G'.
    """
    wg = weights @ gradients.T
    s = float(gradients[-1] @ weights[-1]) / (float(weights[-1] @ weights[-1]) + 1e-12)
    lower = np.tril(wg, -1)
    m = np.block([[s * (weights @ weights.T), lower], [lower.T, -np.diag(np.diag(wg))]])
    rhs = np.concatenate([s * (weights @ v), gradients @ v])
    try:
        solved = np.linalg.solve(m, rhs)
    except np.linalg.LinAlgError:
        solved = np.linalg.solve(m + 1e-6 * np.eye(len(m)), rhs)
    return s * v - np.concatenate([s * weights, gradients]).T @ solved


def _scatter(x: np.ndarray, k: int, r: np.random.Generator) -> tuple[np.ndarray, float]:
    """Best labels of k means on numbers, and the sum of squared distances to their centres."""
    label, cost = _best(x[None], np.stack([r.choice(x, k, replace=False) for _ in range(10)])[None])
    return label[0], float(cost[0])


def _best(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for each row of ``x``, from its own starts (rows, tries, k); all tries are moved together."""
    rows, tries, k = centres.shape
    x, now = np.repeat(x, tries, axis=0), centres.reshape(rows * tries, k).copy()
    label, open_ = np.zeros(x.shape, int), np.arange(len(x))
    for _ in range(30):
        own, at = x[open_], now[open_]
        label[open_] = near = np.abs(own[:, :, None] - at[:, None]).argmin(2)
        inside = near[:, :, None] == np.arange(k)
        count = inside.sum(1)
        new = np.where(count > 0, (own[:, :, None] * inside).sum(1) / np.maximum(count, 1), at)
        still = np.isclose(new, at).all(1)
        now[open_[~still]] = new[~still]
        open_ = open_[~still]
        if not len(open_):
            break
    cost = ((x - np.take_along_axis(now, label, 1)) ** 2).sum(1).reshape(rows, tries)
    best = cost.argmin(1)
    return label.reshape(rows, tries, -1)[np.arange(rows), best], cost[np.arange(rows), best]


@lru_cache(maxsize=1 << 10)
def _drawn(n: int, k: int, samples: int, seed: int) -> tuple[np.ndarray, float, float, dict]:
    """The gap statistic's random part for ``k`` clusters of ``n`` scores: where their tries start, mean and deviation of the logarithms
    that uniform numbers give, and the generator's state afterwards. It knows nothing of the scores, so rounds of equally many share it.
    """
    r = np.random.default_rng(seed)
    if k > 1:
        r.bit_generator.state = _drawn(n, k - 1, samples, seed)[3]
    own = np.stack([r.choice(n, k, replace=False) for _ in range(10)])
    drawn, starts = [], []
    for _ in range(samples):
        drawn.append(r.random(n))
        starts.append([r.choice(drawn[-1], k, replace=False) for _ in range(10)])
    other = np.log(np.maximum(_best(np.array(drawn), np.array(starts))[1], 1e-12))
    return own, float(np.mean(other)), float(np.std(other)), r.bit_generator.state


def gap_clusters(score: np.ndarray, most: int = 10, samples: int = 20, seed: int = 0) -> int:
    """The gap statistic's number of clusters of scores scaled to [0, 1], at most ``most``."""
    x = (score - score.min()) / max(float(np.ptp(score)), 1e-12)
    before = 0.0
    for k in range(1, min(most, len(np.unique(x))) + 1):
        starts, other, deviation, _ = _drawn(len(x), k, samples, seed)
        gap = other - np.log(max(float(_best(x[None], x[starts][None])[1][0]), 1e-12))
        if k > 1 and before >= gap - deviation * np.sqrt(1 + 1 / samples):
            return k - 1
        before = gap
    return max(1, min(most, len(np.unique(x))))


def detector(updates: DataFrame, window: int = 3, start: int = 0, **options: Any) -> DataFrame:
    """(round, coord, value): the mean of the clients whose updates follow the predicted ones.

    A client's update is predicted as its last one plus the curvature times the last aggregate; the distances,
    normalised in a round and averaged over ``window`` rounds, are split in two where the gap statistic sees
    clusters, and the cluster of lower distance is kept. The state is the aggregates of the last rounds, the clients' distances of the
    last scored ones, and the rows of the last one. ``options`` are those of ``by_round``.
    """

    def step(state: Any, ids: np.ndarray, m: np.ndarray, number: int) -> tuple[Any, np.ndarray]:
        own, scores, scored, known = state or ([], [], 0, {})
        if own and number - start > window:
            last, steps = own, [b - a for a, b in zip([np.zeros_like(own[0]), *own[:-1]], own, strict=True)]
            if len(own) > window:  # the first of them only tells where the second began
                last, steps = own[1:], steps[1:]
            moved = curvature_product(np.array(last), np.array(steps), last[-1])
            far = np.array([np.linalg.norm(known[c] + moved - v) if c in known else 0.0 for c, v in zip(ids.tolist(), m, strict=True)])
            scores = [*scores, dict(zip(ids.tolist(), (far / (far.sum() + 1e-12)).tolist(), strict=True))][-window:]
            scored = min(scored + 1, window + 1)
        kept = np.ones(len(m), bool)
        if scored > window:
            seen = {c: [x[c] for x in scores if c in x] for c in ids.tolist()}
            score = {c: float(np.mean(x)) for c, x in sorted(seen.items()) if x}
            value = np.array(list(score.values()))
            if len(value) and gap_clusters(value, 2) >= 2:
                label = _scatter(value, 2, np.random.default_rng(0))[0]
                gone = label == int(value[label == 0].mean() <= value[label == 1].mean())
                kept = ~np.isin(ids, np.array(list(score))[gone])
        now = m[kept].mean(0)
        return ([*own, now][-window - 1 :], scores, scored, dict(zip(ids.tolist(), m, strict=True))), now

    def same(a: Any, b: Any) -> bool:
        """Bit by bit."""
        return a[1:3] == b[1:3] and len(a[0]) == len(b[0]) and all(map(np.array_equal, a[0], b[0])) and a[3].keys() == b[3].keys() and all(np.array_equal(a[3][c], b[3][c]) for c in a[3])

    return by_round(updates, step, same, **options)
