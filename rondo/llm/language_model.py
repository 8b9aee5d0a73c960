"""LM scoring with a log-frequency Bloom filter.

The texts are cut into chunks of about CHUNK tokens, each one row of a written table: the hashes of its distinct
words and the place of every token in them. N-grams are dealt into blocks by their hash, as many as hold about BLOCK tokens
each; inside its block a pair goes by the next KEY_BITS bits of its hash, so two pairs of a block are taken for one as rarely at
every size.

The filter is built once: the chunks send the counts of their training word pairs to the pairs' blocks, and the sums are stored
as quantised levels, 1 + floor(log2(count)): a pair of level q is in the block's filter as the q items (pair, 1) ...
(pair, q), at BITS_PER_ITEM bits an item or more. Only these bits are written. Scoring has nothing else of the pairs: it
reads a level back by repeated membership probes, level after level until one fails, so a pair that was never seen may
pass by chance. A filter of at most BROADCAST_BYTES is broadcast to the workers whole; a larger one by its blocks, each to the
task that answers the chunks' questions about its pairs, and a second shuffle brings the levels back. Both ways probe
the same bits, and the error rate keeps its bound at every size.

A text's score sums log10 of the smoothed probability of each word after the one before it,
``(c(v w) + MU * p(w)) / (c(v) + MU)`` with ``p(w) = (c(w) + 1) / (N + V + 1)``, the end of the text as last word;
c(v w) is the middle of the pair's level. The base score sums log10 p(w). N, V and counts of single words, which the base
score needs, are exact: they meet by block and go back to the chunks that asked.

Defined cases: a null or wordless text is one end; without training texts N = V = 0 and every count is 0;
rows of equal id and text are scored each and, in training, counted each; a null id is in the training part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.llm import bytescan as bs
from rondo.llm.common import BIG_ROWS, cut, fold, map_arrow_all, parts_for
from rondo.sources.shared import settings

BITS_PER_ITEM = 8
KEY_BITS = 32
PROBES = 4
MU = 1000.0
CHUNK = 1 << 20
BLOCK = 1 << 20
#: A filter of so many bytes at most is broadcast as a whole.
BROADCAST_BYTES = 4 << 20
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6B27D4EB4F)
_ONE, _LEVEL = np.uint64(0x2545F4914F6CDD1D), 0xA0761D6478BD642F


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a slice's tokens, with an end for each text, and the text of each."""
    words = bs.Words(data, offs)
    n = len(offs) - 1
    at = np.cumsum(words.per_doc())
    return np.insert(words.hash, at, END), np.insert(words.doc, at, np.arange(n))


def pairs(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token (BEGIN for the first) and the hash of both."""
    before = np.append(BEGIN, token[:-1])
    before[np.append(True, doc[1:] != doc[:-1])] = BEGIN
    return before, bs.mix(before * np.uint64(bs._P) + token)


def single(token: np.ndarray) -> np.ndarray:
    return bs.mix(token ^ _ONE)


def _place(key: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """The bit that a probe of (key, level) looks at in a block of 2**bits bits."""
    h = bs.mix(key.astype(np.uint64) + np.uint64(level * _LEVEL % 2**64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(probe) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


class LogFrequencyFilter:
    """The bits of each block, chosen by the top bits of the n-gram's hash; a block without items may be left out."""

    def __init__(self, blocks: dict[int, np.ndarray], many: int):
        self.blocks, self.many = blocks, many

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 for one that is not in the filter."""
        level = np.zeros(len(key), np.int64)
        block = block_of(key, self.many)
        order = np.argsort(block, kind="stable")
        own, first = np.unique(block[order], return_index=True)
        for k, at in zip(own.tolist(), np.split(order, first[1:]), strict=True):
            if k in self.blocks:
                level[at] = _probed(self.blocks[k], short(key[at], self.many))
        return level


def _probed(flags: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Levels by probes of one block's bytes."""
    bits = (len(flags) * 8).bit_length() - 1
    level, live, q = np.zeros(len(key), np.int64), np.arange(len(key)), 0
    while len(live):
        q += 1
        for probe in range(PROBES):
            place = _place(key[live], q, probe, bits)
            live = live[(flags[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
        level[live] = q
    return level


def middle(level: np.ndarray) -> np.ndarray:
    return np.where(level > 1, 1.5 * 2.0 ** (level - 1), level.astype(float))


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return (key >> np.uint64(65 - blocks.bit_length())).astype(np.int64) if blocks > 1 else np.zeros(len(key), np.int64)


def short(key: np.ndarray, blocks: int) -> np.ndarray:
    """The bits of a hash by which an n-gram goes inside its block; sorted where the hashes of a block are."""
    return ((key << np.uint64(blocks.bit_length() - 1)) >> np.uint64(64 - KEY_BITS)).astype(np.uint32)


def build_block(key: np.ndarray, count: np.ndarray, bits: int = 0) -> np.ndarray:
    """One block of the filter from the counts of its n-grams, by their short keys, which may come in parts; 2**bits bits, or more if its items need them."""
    order = np.argsort(key)
    key, count = key[order], count[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, total = key[head], np.add.reduceat(count, head) if len(key) else count
    level = 1 + np.log2(np.maximum(total, 1)).astype(np.int64)
    bits = max(bits, 10, int(np.ceil(np.log2(max(1, level.sum() * BITS_PER_ITEM)))))
    flags = np.zeros(1 << bits, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = key[level >= q]
        for probe in range(PROBES):
            flags[_place(own, q, probe, bits)] = True
    return np.packbits(flags, bitorder="little")


def _pack(x: np.ndarray, gaps: bool = False) -> bytes:
    """Planes of bytes, of the gaps if they are sorted keys, as upper bytes are mostly zeros: by Zstandard, or as they are if they are few."""
    x = np.diff(x, prepend=x.dtype.type(0)) if gaps else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return b"z" + zstandard.ZstdCompressor(level=1).compress(planes) if len(planes) >= 256 else b"p" + planes


def _unpack(data: bytes, kind: type, gaps: bool = False) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"z" else data[1:]
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=kind) if gaps else x


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, ids, held, sizes, words, places) of ``docs`` (doc_id, held_out, text): runs of texts of about ``size`` tokens.

    ``words`` are the hashes of the distinct tokens in the order of ``single``, ``places`` has the index of each token in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number, parts, total = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for rows, data, offs in bs.slices(batch.column(2), min(bs.SLICE_BYTES, 8 * size)):
                token, doc = tokens(data, offs)
                ids, held = (batch.column(k).slice(rows.start, len(rows)) for k in (0, 1))
                parts.append((ids, held, np.bincount(doc, minlength=len(rows)), token))
                total += len(token)
                if total >= size:
                    yield row(number, parts)
                    number, parts, total = number + 1, [], 0
        if parts:
            yield row(number, parts)

    def row(number: int, parts: list) -> dict:
        ids, held, sizes, token = (list(x) for x in zip(*parts, strict=True))
        token = np.concatenate(token)
        _, first, places = np.unique(single(token), return_index=True, return_inverse=True)
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return {
            "chunk": [number], "ids": listed(pa.concat_arrays(ids)), "held": listed(pa.concat_arrays(held)), "sizes": listed(pa.array(np.concatenate(sizes))),
            "words": [token[first].tobytes()], "places": [places.astype(np.uint32).tobytes()], "n_tokens": [len(token)],
        }

    schema = "chunk long, ids array<long>, held array<boolean>, sizes array<long>, words binary, places binary, n_tokens long"
    return cut(map_arrow_all(docs, run, schema), **BIG_ROWS)


def _by_block(key: np.ndarray, blocks: int) -> tuple[np.ndarray, list[slice]]:
    """The blocks that sorted keys belong to, and where each one's are."""
    own, first = np.unique(block_of(key, blocks), return_index=True)
    edge = np.append(first, len(key))
    return own, [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _large_rows(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``map_arrow_all`` in batches of a few rows, written out."""
    spark = df.sparkSession
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):
        return cut(map_arrow_all(df, f, schema), **BIG_ROWS)


def build_filter(table: DataFrame, blocks: int) -> DataFrame:
    """(block, flags): the filter of the training texts' word pairs, written out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for held, sizes, words, places in _columns(batch):
                words, places = np.frombuffer(words, np.uint64), np.frombuffer(places, np.uint32)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                pair, n = np.unique(pairs(words[places], doc)[1][~np.array(held, bool)[doc]], return_counts=True)
                own, where = _by_block(pair, blocks)
                yield {"block": own, "pairs": [_pack(short(pair[x], blocks), True) for x in where], "n": [_pack(n[x].astype(np.uint32)) for x in where]}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, *part in _columns(batch):
                held.setdefault(block, []).append(part)
        while held:
            block, parts = held.popitem()
            key, n = (np.concatenate([_unpack(x, np.uint32, gaps) for x in own]) for own, gaps in zip(zip(*parts, strict=True), (True, False), strict=True))
            yield {"block": [block], "flags": [build_block(key, n.astype(np.int64)).tobytes()]}

    sent = map_arrow_all(table.select("held", "sizes", "words", "places"), count, "block int, pairs binary, n binary")
    return _large_rows(sent.repartition(blocks, "block"), build, "block int, flags binary")


def word_counts(table: DataFrame, blocks: int) -> DataFrame:
    """(chunk, block, one, n, v): the exact training counts of a chunk's words that belong to a block, written out.

    n and v sum to the numbers of tokens and of distinct tokens of the training texts.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, held, sizes, words, places in _columns(batch):
                words, places = np.frombuffer(words, np.uint64), np.frombuffer(places, np.uint32)
                trained = ~np.repeat(np.array(held, bool), sizes)
                n = np.bincount(places[trained], minlength=len(words)).astype(np.uint32)
                key = single(words)
                own, where = _by_block(key, blocks)
                yield {"block": own, "chunk": np.full(len(own), chunk), "words": [_pack(key[x], True) for x in where], "n": [_pack(n[x]) for x in where]}

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, *part in _columns(batch):
                held.setdefault(block, []).append(part)
        while held:
            block, parts = held.popitem()
            chunk, words, n = zip(*parts, strict=True)
            words = [_unpack(x, np.uint64, True) for x in words]
            key, at = np.unique(np.concatenate(words), return_inverse=True)
            sums = np.bincount(at, np.concatenate([_unpack(x, np.uint32) for x in n]), len(key)).astype(np.int64)
            dealt = np.split(sums[at], np.cumsum([len(x) for x in words])[:-1])
            first = np.arange(len(parts)) == 0
            yield {"chunk": chunk, "block": [block] * len(parts), "one": [_pack(x) for x in dealt], "n": first * sums.sum(), "v": first * (sums > 0).sum()}

    sent = map_arrow_all(table.select("chunk", "held", "sizes", "words", "places"), ask, "block int, chunk long, words binary, n binary")
    return _large_rows(sent.repartition(blocks, "block"), total, "chunk long, block int, one binary, n long, v long")


def probed_levels(table: DataFrame, flags: DataFrame, blocks: int) -> DataFrame:
    """(chunk, block, two): the levels of a chunk's pairs by probes of their block, whose task has the block's bits and the pairs only."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, sizes, words, places in _columns(batch):
                words, places = np.frombuffer(words, np.uint64), np.frombuffer(places, np.uint32)
                pair = np.unique(pairs(words[places], np.repeat(np.arange(len(sizes)), sizes))[1])
                own, where = _by_block(pair, blocks)
                yield {"block": own, "chunk": np.full(len(own), chunk), "data": [_pack(short(pair[x], blocks), True) for x in where]}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits: dict[int, np.ndarray] = {}
        asked: dict[int, list] = {}
        for batch in batches:
            for block, chunk, data in _columns(batch):
                if chunk is None:
                    bits[block] = np.frombuffer(data, np.uint8)
                else:
                    asked.setdefault(block, []).append((chunk, data))
        while asked:
            block, parts = asked.popitem()
            keys = [_unpack(x, np.uint32, True) for _, x in parts]
            two = [_probed(bits[block], x) if block in bits else np.zeros(len(x), np.int64) for x in keys]
            yield {"chunk": [c for c, _ in parts], "block": [block] * len(parts), "two": [_pack(x.astype(np.uint8)) for x in two]}

    sent = map_arrow_all(table.select("chunk", "sizes", "words", "places"), ask, "block int, chunk long, data binary")
    both = sent.unionByName(flags.select("block", F.lit(None).cast("long").alias("chunk"), F.col("flags").alias("data")))
    return _large_rows(both.repartition(blocks, "block"), answer, "chunk long, block int, two binary")


def score(docs: DataFrame, chunk: int = CHUNK, mu: float = MU, broadcast_bytes: int = BROADCAST_BYTES, block: int = BLOCK) -> DataFrame:
    """op3: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``broadcast_bytes`` decides how the filter reaches the workers and changes no score.
    """
    spark = docs.sparkSession
    table = chunks(docs.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text"), chunk)
    n_tokens = table.agg(F.sum("n_tokens")).head()[0] or 0
    blocks = 1 << max(4, int(np.ceil(np.log2(max(1, n_tokens) / block))))
    known = word_counts(table, blocks)
    n, v = (x or 0 for x in known.agg(F.sum("n"), F.sum("v")).head())
    base = float(n + v + 1)
    flags = build_filter(table, blocks)
    size = flags.agg(F.sum(F.length("flags"))).head()[0] or 0
    shared = None
    if size <= broadcast_bytes:  # the bound of what is collected and broadcast
        shared = spark.sparkContext.broadcast({x["block"]: bytes(x["flags"]) for x in flags.toLocalIterator()})
    replies = known.select("chunk", "block", "one", F.lit(None).cast("binary").alias("two"))
    if shared is None:
        replies = replies.unionByName(probed_levels(table, flags, blocks).select("chunk", "block", F.lit(None).cast("binary").alias("one"), "two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        texts, met = {}, {}
        for batch in batches:
            for number, block, one, two, *own in _columns(batch):
                if block is None:
                    texts[number] = own
                else:
                    met.setdefault(number, []).append((block, one, two))
        while texts:
            number, (ids, held, sizes, words, at) = texts.popitem()
            answers = sorted(met.pop(number), key=lambda x: x[0])
            gather = lambda k, kind, answers=answers: np.concatenate([np.zeros(0, kind), *(_unpack(x[k], kind) for x in answers if x[k] is not None)])
            words, at = np.frombuffer(words, np.uint64), np.frombuffer(at, np.uint32)
            count = gather(1, np.int64)
            m = len(ids)
            doc = np.repeat(np.arange(m), sizes)
            before, pair = pairs(words[at], doc)
            pair, back = np.unique(pair, return_inverse=True)
            if shared is None:
                level = gather(2, np.uint8).astype(np.int64)
            else:
                level = LogFrequencyFilter({k: np.frombuffer(x, np.uint8) for k, x in shared.value.items()}, blocks).levels(pair)
            p_one = (count + 1) / base
            c_before = count[np.append(at[:1], at[:-1])].astype(float)
            c_before[before == BEGIN] = count[words == END][0]  # each training text has one end
            p = (np.minimum(middle(level)[back], c_before) + mu * p_one[at]) / (c_before + mu)
            yield {
                "doc_id": ids, "held_out": held, "n_tokens": sizes, "n_known": np.bincount(doc[count[at] > 0], minlength=m),
                "base_score": np.bincount(doc, np.log10(p_one)[at], m), "score": np.bincount(doc, np.log10(p), m),
            }

    none = lambda x, names: [F.lit(None).cast(x.schema[c].dataType).alias(c) for c in names]
    told, own = ("block", "one", "two"), ("ids", "held", "sizes", "words", "places")
    rows = table.select("chunk", *none(replies, told), *own).unionByName(replies.select("chunk", *told, *none(table, own)))
    rows = rows.repartition(parts_for(spark, n_tokens, 2 * CHUNK), "chunk")
    out = map_arrow_all(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
