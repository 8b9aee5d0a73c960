"""Vectorised helpers for texts in Arrow batches: slices of UTF-8 bytes, word spans and 64-bit hashes.

A slice is ``(rows, data, offs)``: the batch rows it holds, their UTF-8 bytes end to end and the
``len(rows) + 1`` offsets of the rows in them. A null text counts as an empty one. All separators used
here are ASCII, so a word of bytes is a word of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 65536)
        for name, p in (("_pow", _P), ("_ipow", _P_INV)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _pow[:n], _ipow[:n]


def _table(separators: bytes, fold: bool = True) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte, A-Z in lower case."""
    out = np.arange(256, dtype=np.uint8)
    if fold:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


#: Words of ``[^\\x20\\x09-\\x0D]+``; byte 0 stays a word byte, so the test is on the mask below.
SPACE = bytes([32, 9, 10, 11, 12, 13])
#: Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.
NOT_ALNUM = bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122 or 65 <= x <= 90))


class Words:
    """The words of one slice: ``start``, ``end`` (byte offsets), ``doc`` (row in the slice), ``hash``."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, separators: bytes = SPACE, fold: bool = True):
        is_word = np.ones(256, bool)
        is_word[list(separators)] = False
        inside = is_word[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        left = np.empty(n, bool)
        left[:1] = False
        left[1:] = inside[:-1]
        left[first[:n]] = False
        self.start = np.flatnonzero(inside & ~left)
        right = np.empty(n, bool)
        right[-1:] = False
        right[:-1] = inside[1:]
        right[first[1:]] = False
        self.end = np.flatnonzero(inside & ~right) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.n_docs = len(offs) - 1
        self.hash = span_hash(folded(data) if fold else data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def folded(data: np.ndarray) -> np.ndarray:
    return _table(b"")[data]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i], times the inverse power at i, the polynomial hash of data[i:j].

    For windows of one small size over all places; it is weak for long strings of structure, so spans go by ``span_hash``.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data))[0], out=out[1:])
    return out


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG = 64


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans: eight bytes at a time are mixed in, so up to eight bytes no two spans of a size share one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    size = end - start
    h = mix(eight[start] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_P)
    live, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(live):
        rest = size[live] - k
        h[live] = mix(h[live] + (eight[start[live] + k] & _LOW[np.minimum(rest, 8)]))
        live, k = live[rest > 8], k + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return mix(h)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row inside one document, and the index of the first word of each."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(_P) + words[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(acc[at]), at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``limit`` bytes; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        own = offs[at : to + 1]
        yield range(at, to), data[own[0] : own[-1]], own - own[0]
        at = to

