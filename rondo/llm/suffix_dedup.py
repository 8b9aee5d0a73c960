"""Suffix-array dedup: removes every byte covered by a string of ``WIDTH`` bytes that also starts elsewhere.

Anchors keep the arrays sparse. In each window of WIDTH - GRAM + 1 byte positions the GRAM-byte string of least
hash is the window's anchor: it depends on the WIDTH bytes at that place only, so equal strings of WIDTH bytes
have equal anchors, and a window whose anchor has no second occurrence needs no look. The starts that share
one anchor occurrence form an interval; the bytes they read, ``WIDTH - 1`` more than the interval, are a
*context*.

1. Count anchors over the corpus; those found twice go into a bit filter of bounded size.
2. Cut out the contexts of repeated anchors and range-partition them by anchor and document: the shards. A very
   common anchor spreads over several shards.
3. Each shard builds the suffix array of its contexts in numpy by Larsson-Sadakane refinement (ranks of 8, 16,
   ... bytes, only groups that are still tied are sorted again) and the common prefixes of neighbours by
   Kasai's rule; starts with a common prefix of WIDTH bytes are duplicates.
4. A very common anchor is cut over shards, as may be the first and the last anchor of a partition. The distinct strings
   of such anchors are merged across shards: sorted runs of 128-bit blake2b digests, looked up by binary search.
5. The duplicate starts of a document become intervals, joined to its text.

Defined cases: a null text is empty; a text shorter than WIDTH bytes loses nothing; the rows of equal id and
text are copies of each other, and each loses what the others have; null ids take part. Only the numbers
of the result are returned by the query; ``clean`` returns the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.llm import bytescan as bs
from rondo.llm.common import Counter64, KeyFilter, cut, map_arrow, map_arrow_all, packed, parts_for, through

WIDTH = 200
GRAM = 48
#: Bytes of contexts in a shard, about: its arrays take some hundred times that.
SHARD_BYTES = 1 << 20
#: Bytes of contexts in a partition; its shards are built one after the other.
PARTITION_BYTES = 64 << 20
#: Bits of a place in a slice, the same for each, so that equal windows have equal anchors everywhere.
_PLACE_BITS = 31


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least entry of each window of w entries."""
    n = len(h) - w + 1
    block = np.append(h, np.full(-len(h) % w, np.uint64(2**64 - 1))).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, first start, number of starts, times) of each run of starts with one key, in a slice.

    The key is the hash at the leftmost least place of a start's window, so it depends on these bytes alone.
    ``times`` is 2 where that place moves inside the run, as in a text that repeats itself: only there can two
    starts of one run have equal bytes.
    """
    m = len(data) - width + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    hashes = all_hashes(data, gram)
    low = np.uint64(_PLACE_BITS)
    spot = _window_min((hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64), width - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))
    least = hashes[spot]
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    valid = doc[:m] == doc[width - 1 :]
    head = np.append(True, (least[1:] != least[:-1]) | (doc[1:m] != doc[: m - 1]) | (valid[1:] != valid[:-1]))
    at = np.flatnonzero(head)
    starts = np.diff(np.append(at, m))
    moved = spot[np.append(at[1:], m) - 1] != spot[at]
    keep = valid[at]
    at, starts = at[keep], starts[keep]
    return doc[at], least[at], at, starts, 1 + moved[keep]


def all_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes at each place that has as many."""
    prefix = bs.prefix_hash(data)
    n = len(data) - size + 1
    return bs.mix((prefix[size:] - prefix[:n]) * bs._powers(len(data) + 1)[1][:n])


def suffix_array(data: np.ndarray, end: np.ndarray, wanted: int) -> np.ndarray:
    """Larsson-Sadakane: the suffixes in order of their first ``wanted`` bytes, then of their position.

    ``end[i]`` is where the text of position i ends; past it nothing follows, which sorts first. Each pass
    doubles the sorted length and sorts only the positions whose rank is still shared.
    """
    n = len(data)
    padded = np.append(data.astype(np.uint64), np.zeros(8, np.uint64))
    left = end - np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(7):  # seven bytes and the length inside the text
        key = (key << np.uint64(8)) | np.where(left > j, padded[j : n + j], 0)
    key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.empty(n, np.int64)
    place = np.flatnonzero(head)
    rank[order] = np.repeat(place, np.diff(np.append(place, n)))
    h = 7
    while h < wanted:
        size = np.diff(np.append(place, n))
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        after = own + h
        second = np.where(after < end[own], rank[np.minimum(after, n - 1)], -1)
        first = rank[own]
        again = np.lexsort((second, first))
        order[at] = own[again]
        f, s = first[again], second[again]
        new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))
        head[at] = new
        place = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        rank[order[at]] = place[group[at]]
        h *= 2
    return order


def kasai(data: np.ndarray, end: np.ndarray, order: np.ndarray, most: int, lanes: int = 2048) -> np.ndarray:
    """The common prefix of each suffix with the one before it in ``order``, up to ``most`` bytes.

    Kasai's rule (from one position to the next the common prefix shrinks by one at most) runs along many
    stretches of the data at once, each a lane of a vector.
    """
    n = len(data)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    before = np.where(where > 0, order[np.maximum(where - 1, 0)], -1)
    step = max(1, -(-n // lanes))
    at = np.arange(0, n, step)
    stop = np.minimum(at + step, n)
    have = np.zeros(len(at), np.int64)
    out = np.zeros(n, np.int64)
    padded = np.append(data, 0)
    live = np.arange(len(at))
    while len(live):
        i, k = at[live], have[live]
        j = before[i]
        here, there = i + k, j + k
        more = (j >= 0) & (k < most) & (here < end[i]) & (there < end[np.maximum(j, 0)])
        more &= padded[np.minimum(here, n)] == padded[np.clip(there, 0, n)]
        have[live[more]] += 1
        done = live[~more]
        out[at[done]] = have[done]
        have[done] = np.maximum(have[done] - 1, 0)
        at[done] += 1
        live = live[at[live] < stop[live]]
    return out


def _contexts(rows: DataFrame, width: int, gram: int) -> tuple[DataFrame, int]:
    """(anchor, doc_id, tk, start, piece) of the repeated anchors, and how many bytes they are about."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Counter64()
        for batch in batches:
            for _, data, offs in bs.slices(batch.column(0)):
                _, key, _, _, times = anchors(data, offs, width, gram)
                yield from seen.add(np.repeat(key, times))
        yield from seen.flush()

    counts = map_arrow_all(rows.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    counts = cut(counts)
    n, total = counts.agg(F.count("*"), F.sum("n")).head()
    passes = rows.sparkSession.sparkContext.broadcast(KeyFilter.of(counts, "key", 4 * n))  # 2**28 bits at most

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, data, offs in bs.slices(batch.column(2)):
            doc, key, at, starts, _ = anchors(data, offs, width, gram)
            ok = passes.value.passes(key)
            doc, at, starts = doc[ok], at[ok], starts[ok]
            taken = pa.array(doc.astype(np.int64) + rows.start)
            yield {
                "anchor": key[ok].view(np.int64), "doc_id": batch.column(0).take(taken), "tk": batch.column(1).take(taken), "start": at - offs[doc],
                "piece": [data[a : a + k + width - 1].tobytes() for a, k in zip(at.tolist(), starts.tolist(), strict=True)],
            }

    return map_arrow(rows.select("doc_id", "tk", "text"), run, "anchor long, doc_id long, tk long, start long, piece binary"), int(total or 0) * 3 * width // 2


def _shard(pieces: pa.Array, width: int) -> dict[str, np.ndarray]:
    """The starts of one shard's contexts: ``flags`` of the duplicates, and a digest of the ``strings`` at some of them.

    Equal contexts are one from here on (``of`` tells which), all of whose starts are duplicates. A context without
    a string whose fingerprint recurs in the shard shares none, as equal strings have equal fingerprints; the suffix array
    holds all others, and it alone decides for them.
    """
    coded = pieces.dictionary_encode()
    of = coded.indices.to_numpy()
    several = np.bincount(of, minlength=len(coded.dictionary)) > 1
    distinct = coded.dictionary.cast(pa.large_binary())
    _, raw, blob = distinct.buffers()
    offs = np.frombuffer(raw, np.int64, len(distinct) + 1, distinct.offset * 8)
    data = np.frombuffer(blob, np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    length = np.diff(offs)
    starts = length - width + 1
    bound = np.append(0, np.cumsum(starts))
    owner = np.repeat(np.arange(len(starts)), starts)
    first = np.arange(bound[-1]) - bound[owner] + offs[owner]
    prints = all_hashes(data, width)[first]
    _, inverse, times = np.unique(prints, return_inverse=True, return_counts=True)
    flags = several[owner]
    look = np.zeros(len(starts), bool)
    look[owner[times[inverse] > 1]] = True
    if look.any():
        some = np.flatnonzero(look)
        own = length[some]
        own_end = np.cumsum(own)
        text = data[np.repeat(offs[some] - (own_end - own), own) + np.arange(own_end[-1])]
        end = np.repeat(own_end, own)
        order = suffix_array(text, end, int(own.max()))
        shared = kasai(text, end, order, width)[order] >= width
        group = np.cumsum(~shared)  # suffixes in a row that share width bytes
        size = np.bincount(group)
        twice = np.zeros(len(text), bool)
        twice[order] = size[group] > 1
        inside = np.flatnonzero(look[owner])
        shift = np.zeros(len(starts), np.int64)
        shift[some] = own_end - own - offs[some]
        flags[inside] |= twice[first[inside] + shift[owner[inside]]]

    def strings(at: np.ndarray) -> np.ndarray:
        """128 bits of digest, as two numbers, of the string of each start."""
        raw = data.tobytes()
        return np.frombuffer(b"".join(hashlib.blake2b(raw[i : i + width], digest_size=16).digest() for i in first[at].tolist()), np.int64).reshape(-1, 2)

    return {"of": of, "bound": bound, "flags": flags, "strings": strings}


def duplicates(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, tk, start, n): runs of starts of a text whose width-byte string also starts elsewhere."""
    contexts, size = _contexts(rows, width, gram)
    parts = parts_for(rows.sparkSession, size, PARTITION_BYTES)
    dealt = contexts.repartitionByRange(parts, "anchor", "doc_id", "tk", "start").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """A partition's shards, one after the other: whole anchors, or parts of a large one, which stay open to other shards."""
        held: list[pa.RecordBatch] = []
        size, open_ = 0, True  # the first anchor may have begun in the partition before
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > shard_bytes:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column("anchor").to_numpy()
                inner = np.flatnonzero(key[1:] != key[:-1]) + 1
                k = int(inner[-1]) if len(inner) else len(key)
                yield from piece(whole.slice(0, k), open_, not len(inner))
                open_ = not len(inner)
                held = whole.slice(k).combine_chunks().to_batches() if k < len(key) else []
                size = sum(b.nbytes for b in held)
        if held:
            yield from piece(pa.Table.from_batches(held).combine_chunks(), open_, True)

    def piece(table: pa.Table, first_open: bool, last_open: bool) -> Iterator[dict]:
        if not len(table):
            return
        names = {k: table.column(k).combine_chunks() for k in ("doc_id", "tk", "anchor", "start", "piece")}
        found = _shard(names["piece"], width)
        of, bound, flags = found["of"], found["bound"], found["flags"]
        anchor, start = (names[k].to_numpy() for k in ("anchor", "start"))
        many = np.diff(bound)[of]
        row = np.repeat(np.arange(len(of)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        flag = flags[bound[of[row]] + place]
        r, s = row[flag], start[row[flag]] + place[flag]
        if len(r):
            head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)))
            yield {"doc_id": names["doc_id"].take(pa.array(r[head])), "tk": names["tk"].take(pa.array(r[head])), "start": s[head], "n": np.diff(np.append(head, len(r))), "print": np.zeros(len(head), np.int64), "print2": np.zeros(len(head), np.int64)}
        # open anchors may go on in another shard: their strings, each once, with its place if it is alone
        edge = np.zeros(len(anchor), bool)
        if first_open:
            edge |= anchor == anchor[0]
        if last_open:
            edge |= anchor == anchor[-1]
        _, one = np.unique(of, return_index=True)
        one = one[edge[one]]
        if len(one):
            at = np.concatenate([np.arange(bound[of[i]], bound[of[i] + 1]) for i in one])
            r = np.repeat(one, np.diff(bound)[of[one]])
            s = start[r] + at - bound[of[r]]
            prints = found["strings"](at)
            _, pick = np.unique(prints, axis=0, return_index=True)
            r, s, at, prints = r[pick], s[pick], at[pick], prints[pick]
            yield {"doc_id": names["doc_id"].take(pa.array(r)), "tk": names["tk"].take(pa.array(r)), "start": s, "n": np.where(flags[at], -2, -1), "print": prints[:, 0], "print2": prints[:, 1]}

    out = cut(map_arrow_all(dealt, run, "doc_id long, tk long, start long, n long, print long, print2 long"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Looks each string that was alone in its shard up in the sorted strings of all shards."""
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            prints = np.stack([table.column(k).to_numpy() for k in ("print", "print2")], 1)
            order = np.lexsort((prints[:, 1], prints[:, 0]))
            head = np.append(True, (prints[order][1:] != prints[order][:-1]).any(1))
            runs = np.flatnonzero(head)
            at = np.searchsorted(runs, np.arange(len(order)), "right") - 1
            times = np.empty(len(order), np.int64)
            times[order] = np.diff(np.append(runs, len(order)))[at]
            hit = table.filter(pa.array((times > 1) & (table.column("n").to_numpy() == -1)))
            yield {k: hit.column(k).combine_chunks() for k in ("doc_id", "tk", "start")} | {"n": np.ones(len(hit), np.int64)}

    edges = out.where("n < 0")
    dealt = edges.repartitionByRange(parts_for(rows.sparkSession, edges.count(), 1e6), "print")
    across = map_arrow_all(dealt, merge, "doc_id long, tk long, start long, n long")
    return out.where("n > 0").select("doc_id", "tk", "start", "n").unionByName(across)


def _covered(docs: DataFrame, width: int, gram: int, shard_bytes: int) -> DataFrame:
    """The documents with ``_runs``, the duplicate starts of each as (start, n)."""
    rows = docs.withColumn("_tk", F.xxhash64("text"))
    runs = duplicates(rows.select("doc_id", F.col("_tk").alias("tk"), "text"), width, gram, shard_bytes)
    runs = runs.groupBy(F.col("doc_id").alias("_id"), F.col("tk").alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    return rows.join(runs.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tk") == F.col("_key")), "left").drop("_id", "_key", "_tk")


def _gone(size: int, runs: list[dict] | None, width: int) -> np.ndarray:
    step = np.zeros(size + 1, np.int64)
    if runs:
        start = np.array([x["start"] for x in runs])
        np.add.at(step, start, 1)
        np.add.at(step, start + np.array([x["n"] for x in runs]) + width - 1, -1)
    return np.cumsum(step)[:size] > 0


def report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """op7: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, runs in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            data = np.frombuffer(text.as_py() or b"", np.uint8)
            gone = _gone(len(data), runs.as_py(), width)
            for name, v in (("n_bytes", len(data)), ("n_removed", int(gone.sum())), ("n_spans", int((gone & ~np.append(False, gone[:-1])).sum())), ("kept_sha256", hashlib.sha256(data[~gone].tobytes()).hexdigest())):
                out[name].append(v)
        yield {"doc_id": batch.column(0)} | out

    rows = _covered(docs.select("doc_id", "text"), width, gram, shard_bytes).select("doc_id", "text", "_runs")
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without the bytes; what is left of a cut character is dropped. ``n_chars`` follows. Other columns pass through, whatever their names."""
    return packed(docs, lambda own: _cleaned(own, width, gram, shard_bytes))


def _cleaned(docs: DataFrame, width: int, gram: int, shard_bytes: int) -> DataFrame:
    rows = _covered(docs, width, gram, shard_bytes)
    text, runs = rows.columns.index("text"), rows.columns.index("_runs")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        new = []
        for t, r in zip(batch.column(text).cast(pa.large_binary()), batch.column(runs), strict=True):
            data = t.as_py()
            new.append(None if data is None else np.frombuffer(data, np.uint8)[~_gone(len(data), r.as_py(), width)].tobytes().decode(errors="ignore"))
        yield through(batch, {"text": pa.array(new, pa.string())})

    out = map_arrow(rows, run, rows.schema).drop("_runs")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out
