"""Quality rules: text measures, and a calibrated logistic regression over hashed word and character n-grams.

``measure`` counts, per text, words of ``[^\\x20\\x09-\\x0D]+``, their code points, symbols, repeated lines
and words inside repeated three-word windows. The classifier is a logistic regression on hashed frequencies
of one and two words and of two and four characters, fitted by accelerated gradient steps on a bounded sample of
labelled rows; its margin is calibrated on the other half of that sample. Texts are scored in Arrow batches
against fixed thresholds.

Defined cases: a null text has no words and every count 0, so it fails the base rules; without rows of both
classes to learn from, the verdict of the base rules stands and the score is null. Repeated rows count each;
other columns pass through, and one with the name of a result gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rondo.llm import bytescan as bs
from rondo.llm.common import map_arrow, plus, through
from rondo.llm.compression import _logistic, labelled

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text is kept if its calibrated probability of being good is this much at least.
MIN_PROBABILITY = 0.3
BITS = 18
#: The classifier is fitted on this many labelled documents of a class at most, chosen by the hash of their id.
SAMPLE_DOCS = 1500
STEPS = 80
_SCALE = 30.0

FIELDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("score", "double"), ("kept", "boolean"))


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _per_span(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def measure(data: np.ndarray, offs: np.ndarray, words: bs.Words) -> dict[str, np.ndarray]:
    """The five counts of each text of a slice; ``words`` with case kept."""
    n = len(offs) - 1
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    chars = _per_span((data & 0xC0) != 0x80, words.start, words.end)
    # lines: between line feeds and ends of texts; an empty one has no word
    stops = np.union1d(np.flatnonzero(data == 10), offs)
    padded = np.append(data, 0)
    begin, stop = stops[:-1] + (padded[stops[:-1]] == 10), stops[1:]
    first = np.zeros(len(data) + 1, np.int64)
    at = np.zeros(len(data), bool)
    at[words.start] = True
    np.cumsum(at, out=first[1:])
    worded = (stop > begin) & (first[stop] > first[begin])
    begin, stop = begin[worded], stop[worded]
    doc = np.searchsorted(offs, begin, "right") - 1
    key = bs.span_hash(data, begin, stop)
    distinct = np.unique(np.stack([doc.astype(np.uint64), key], 1), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
    dup = np.bincount(doc, minlength=n) - np.bincount(distinct[:, 0].astype(np.int64), minlength=n)
    # words inside windows of three that are found twice or more in their text
    grams, where = bs.ngrams(words.hash, words.doc, 3)
    inside = np.zeros(len(words) + 3, bool)
    if len(grams):
        keyed = bs.mix(grams + words.doc[where].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keyed)
        same = keyed[order][1:] == keyed[order][:-1]
        twice = np.zeros(len(keyed), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            inside[where[twice] + j] = True
    repeat = np.bincount(words.doc[inside[: len(words)]], minlength=n)
    return {
        "n_words": words.per_doc(),
        "word_chars": np.bincount(words.doc, chars, n).astype(np.int64),
        "n_symbols": _sums(is_symbol[data], offs),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def features(data: np.ndarray, offs: np.ndarray, words: bs.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed indices, and the row of the slice of each."""
    mask = np.uint64((1 << BITS) - 1)
    out = []
    for n, salt in ((1, 3), (2, 5)):
        h, at = bs.ngrams(words.hash, words.doc, n)
        out.append(((bs.mix(h + np.uint64(salt)) & mask).astype(np.int32), words.doc[at]))
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lengths = np.diff(offs)
    doc = np.repeat(np.arange(len(lengths)), lengths)[(data & 0xC0) != 0x80]  # of the byte that begins a character
    for n in (2, 4):
        if len(chars) < n:
            continue
        m = len(chars) - n + 1
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x85EBCA6B) + chars[j : j + m]
        h = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 7919)) * np.uint32(0x9E3779B1)
        within = doc[:m] == doc[n - 1 :]
        out.append(((h >> np.uint32(32 - BITS)).astype(np.int32)[within], doc[:m][within]))
    return out


def _margin(parts: list, n: int, weights: np.ndarray) -> np.ndarray:
    total, count = np.zeros(n), np.zeros(n)
    for at, doc in parts:
        total += np.bincount(doc, weights[at], n)
        count += np.bincount(doc, minlength=n)
    return _SCALE * total / np.maximum(count, 1)


@dataclass(frozen=True)
class RulesModel:
    weights: np.ndarray | None
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def probability(self, data: np.ndarray, offs: np.ndarray, words: bs.Words) -> np.ndarray:
        z = _margin(features(data, offs, words), len(offs) - 1, self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None) -> RulesModel:
    """Learns from at most SAMPLE_DOCS labelled documents of a class; executors hash their n-grams."""
    own = labelled(docs, labels, label, SAMPLE_DOCS, learn).select("text", "y", "part", "weight")

    def hashed(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, data, offs in bs.slices(batch.column(0)):
            parts = features(data, offs, bs.Words(data, offs, fold=False))
            at, doc = (np.concatenate([p[k] for p in parts]) for k in (0, 1)) if parts else (np.zeros(0, int), np.zeros(0, int))
            order = np.argsort(doc, kind="stable")
            at, bound = at[order], np.searchsorted(doc[order], np.arange(len(rows) + 1))
            at_, value = [], []
            for i in range(len(rows)):
                index, count = np.unique(at[bound[i] : bound[i + 1]], return_counts=True)
                at_.append(index.astype(np.int32).tobytes())
                value.append((count / max(1, count.sum())).astype(np.float32).tobytes())
            take = pa.array(list(rows))
            yield {"at": at_, "value": value} | {name: batch.column(k).take(take) for k, name in ((1, "y"), (2, "part"), (3, "weight"))}

    rows = map_arrow(own, hashed, "at binary, value binary, y int, part int, weight double").toPandas()
    if rows["y"].nunique() < 2 or rows[rows["part"] == 0]["y"].nunique() < 2 or rows[rows["part"] == 1]["y"].nunique() < 2:
        return RulesModel(None)
    index = [np.frombuffer(x, np.int32) for x in rows["at"]]
    value = [np.frombuffer(x, np.float32) for x in rows["value"]]
    y = rows["y"].to_numpy(float)
    learn_on = np.flatnonzero(rows["part"] == 0)
    col = np.concatenate([index[i] for i in learn_on])
    val = np.concatenate([value[i] for i in learn_on]).astype(np.float64) * _SCALE
    row = np.repeat(np.arange(len(learn_on)), [len(index[i]) for i in learn_on])
    w, bias = _gradient_fit(row, col, val, y[learn_on])
    z = np.array([_SCALE * float(w[i] @ v) + bias for i, v in zip(index, value, strict=True)])
    held = (rows["part"] == 1).to_numpy()
    curve = _logistic(np.stack([np.ones(held.sum()), z[held]], 1), y[held])
    odds = [rows["weight"][rows["y"] == k].sum() / max(1, (rows["y"] == k).sum()) for k in (0, 1)]
    return RulesModel(w.astype(np.float32), bias, float(curve[1]), float(curve[0] + np.log(odds[1] / odds[0])))


def _gradient_fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the whole sample at once."""
    n = len(y)
    w, bias = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], n) + bias, -30, 30)))
        error = (p - y) / n
        g, gb = np.bincount(col, val * error[row], len(w)) + ridge * w, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(bias)


def with_rules(docs: DataFrame, model: RulesModel, only_kept: bool = False) -> DataFrame:
    """The documents with the columns of FIELDS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    text = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, data, offs in bs.slices(batch.column(text)):
            words = bs.Words(data, offs, fold=False)
            out = measure(data, offs, words)
            out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
            if shared.value.weights is None:
                out["score"], out["kept"] = pa.nulls(len(rows), pa.float64()), ~out["base_failed"]
            else:
                out["score"] = shared.value.probability(data, offs, words)
                out["kept"] = ~out["base_failed"] & (out["score"] >= MIN_PROBABILITY)
            yield through(batch.slice(rows.start, len(rows)), out, out["kept"] if only_kept else None)

    return map_arrow(docs, run, plus(docs.schema, *FIELDS))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op2: the counts, ``base_failed`` and ``kept`` of every document, and its score."""
    model = fit(docs, labels)
    return with_rules(docs.select("doc_id", "text"), model).drop("text")
