"""Quality classifier by compression: two zstandard dictionaries and a calibrated size difference.

One dictionary is trained on text labelled good, one on text labelled bad. Every text is cut into chunks of
``CHUNK`` bytes, each compressed with either dictionary; the summed sizes give the normalised difference
``(bad - good) / (bad + good)`` and the ratio of size to length. A logistic curve over these two, fitted on
labelled rows that neither dictionary has seen, turns them into a probability. The logistic is the only other model; labels, language,
source and id never enter a score.

Defined cases: a null text is an empty one; an empty text gets the calibrated score of the share of good
rows (no evidence); a null label or id is not learned from; of several labels of one id the lowest counts;
if a class has no rows to learn from, every score is the share of good rows, or 0.5 without any rows.
Repeated rows are scored each; other columns pass through, and one with the name of a result gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.llm.common import cut, fold, map_arrow, plus, through

CHUNK = 1024
DICT_BYTES = 65536
#: The classifier is fitted on this many labelled documents of a class at most, chosen by the hash of their id ...
SAMPLE_DOCS = 2000
#: ... and a dictionary on this many chunks of them, chosen in the same way.
SAMPLE_CHUNKS = 3000


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        own = [_compressor(x) for x in (self.bad, self.good)] if self.good and self.bad else None

        def score(texts: list[bytes]) -> np.ndarray:
            if own is None:
                return np.full(len(texts), self.prior)
            sizes = np.array([_sizes(x, own) for x in texts], float).reshape(-1, 2)
            n = np.array([len(x) for x in texts], float)
            p = 1 / (1 + np.exp(-np.clip(_features(sizes, n) @ np.array(self.weights), -30, 30)))
            return np.where(n == 0, self.prior, p)

        return score


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False)


def _sizes(text: bytes, own: list) -> list[int]:
    out = [0, 0]
    for at in range(0, len(text), CHUNK):
        piece = text[at : at + CHUNK]
        for k, c in enumerate(own):
            out[k] += len(c.compress(piece))
    return out


def _features(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    both = sizes.sum(1)
    x = 10 * (sizes[:, 0] - sizes[:, 1]) / (both + 16)
    r = np.log((both + 16) / (2 * n + 16))
    return np.stack([np.ones_like(x), x, r, x * r, r * r, x * x, r**3], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with halved steps, so that nearly separable rows don't make it overshoot."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, now = np.linalg.solve(h, x.T @ (p - y) + ridge * w), loss(w)
        for _ in range(30):
            if loss(w - step) < now:
                break
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(chunks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, chunks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(chunks)[-DICT_BYTES:]


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn=None) -> DataFrame:
    """Rows (doc_id, text, y, part) of a bounded sample of the labelled documents; part halves it at random.

    The ids are drawn from the narrow label table, at most ``per_class`` of a class, so the text of the
    others is never moved. ``weight`` is how many labelled rows each sampled one stands for.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        one = one.withColumn("weight", F.lit(counts.get(y, 0) / max(1, min(per_class, counts.get(y, 0)))))
        drawn = one if drawn is None else drawn.unionByName(one)
    drawn = drawn.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    # at most 2 * per_class rows of four numbers: bounded by the parameter
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None) -> CompressionModel:
    """Learns from a sample of the labelled rows that is bounded by SAMPLE_DOCS and SAMPLE_CHUNKS.

    ``learn`` is a condition on the label rows, such as one that leaves a fold out.
    """
    rows = labelled(docs, labels, label, SAMPLE_DOCS, learn)
    own = cut(rows.select("doc_id", "text", "y", "part", "weight"))  # the bounded sample: one pass over the documents

    def chunks(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts, ys = (batch.column(k) for k in (0, 1, 2))
        at = {"y": [], "piece": [], "doc_id": [], "k": []}
        for i, text in enumerate(texts.cast(pa.large_binary())):
            data = text.as_py() or b""
            for k in range(0, len(data), CHUNK):
                for name, x in (("y", ys[i].as_py()), ("piece", data[k : k + CHUNK]), ("doc_id", ids[i].as_py()), ("k", k)):
                    at[name].append(x)
        yield at

    pieces = map_arrow(own.where("part = 0"), chunks, "doc_id long, k long, y int, piece binary")
    found: dict[int, list[bytes]] = {}
    for y in (0, 1):
        taken = pieces.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k").limit(SAMPLE_CHUNKS)
        found[y] = [bytes(r["piece"]) for r in taken.collect()]
    count = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.sum("weight").alias("n")).collect()}
    total = sum(count.values())
    prior = count.get(1, 0) / total if total else 0.5
    if not found[0] or not found[1]:
        return CompressionModel(b"", b"", (), prior)
    bad, good = _dictionary(found[0]), _dictionary(found[1])

    def measured(batch: pa.RecordBatch) -> Iterator[dict]:
        both = [_compressor(x) for x in (bad, good)]
        data = [x.as_py() or b"" for x in batch.column(1).cast(pa.large_binary())]
        sizes = np.array([_sizes(x, both) for x in data], float).reshape(-1, 2)
        yield {"b": sizes[:, 0], "g": sizes[:, 1], "n": [float(len(x)) for x in data], "y": batch.column(2), "weight": batch.column(4)}

    seen = map_arrow(own.where("part = 1"), measured, "b double, g double, n double, y int, weight double").where("n > 0").toPandas()
    if seen["y"].nunique() < 2:
        return CompressionModel(b"", b"", (), prior)
    x, y = _features(seen[["b", "g"]].to_numpy(), seen["n"].to_numpy()), seen["y"].to_numpy(float)
    w = _logistic(x, y)
    # the classes were drawn at different rates: the intercept is moved to the odds of all labelled rows
    odds = (count[1] / max(1e-9, count[0])) / (y.sum() / (len(y) - y.sum()))
    w[0] += np.log(odds)
    return CompressionModel(good, bad, tuple(float(v) for v in w), prior)


def with_score(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, only_kept: bool = False) -> DataFrame:
    """The documents with ``score`` and ``predicted``; with ``only_kept`` those predicted 0 are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most
    text = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        scorer = shared.value.scorer()
        column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        score = np.concatenate([np.zeros(0), *(scorer([x.as_py() for x in column.slice(k, 64)]) for k in range(0, len(column), 64))])
        predicted = (score >= threshold).astype(np.int32)
        yield through(batch, {"score": score, "predicted": predicted}, predicted == 1 if only_kept else None)

    return map_arrow(docs, run, plus(docs.schema, ("score", "double"), ("predicted", "int")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op1: (doc_id, held_out, score, predicted); learns only where crc32(doc_id) mod 5 is not 0."""
    model = fit(docs, labels, "quality", fold("doc_id", 5) != 0)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
