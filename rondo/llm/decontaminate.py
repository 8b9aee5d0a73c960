"""Benchmark decontamination with a generalised suffix automaton.

Benchmark items are normalised (A-Z in lower case, words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and fed
into one suffix automaton over words. Training words stream through it; the length of the longest match is
tracked at each word. Where it reaches ``WINDOW`` words, or the whole of a shorter item, these words are hit.
A word outside the benchmark's vocabulary ends every match, so only runs of known words are streamed.

The automaton is broadcast: it holds ``BLOCK_WORDS`` benchmark words at most. A larger benchmark is dealt into
blocks by the hash of its ids, and the documents are run against one block after the other.

Defined cases: a null or wordless text has no words, hits or items; a null or wordless item matches nothing;
items with equal text or equal id count by id, once; a null item id is not reported but its text still hits.
Repeated document rows are treated each; other columns pass through, one with the name of a result gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.llm import bytescan as bs
from rondo.llm.common import cut, map_arrow, packed, plus, through

WINDOW = 10
BLOCK_WORDS = 200_000
#: Spans of WINDOW words or more are removed; a text that loses more than this share of its words goes.
MAX_COVERAGE = 0.8


class Automaton:
    """Suffix automaton of several word sequences; ``ends[state]`` has the items whose window ends there."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in items)]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, np.searchsorted(self.vocabulary, words).tolist()) for item, words in items]
        for _, words in coded:
            last = 0
            for x in words:
                last = self._add(last, x)
        self.ends: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for item, words in coded:
            state, n = 0, 0
            for x in words:
                state, n = self.step(state, n, x)
                if n == window:
                    self.ends.setdefault(state, set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(state, set()).add((len(words), item))
        self.least = min([window, *(len(words) for _, words in coded if words)])

    def _add(self, last: int, x: int) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, x, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return new

    def _split(self, p: int, x: int, q: int) -> int:
        """A copy of q for the shorter strings that reach it through p."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def step(self, state: int, n: int, x: int) -> tuple[int, int]:
        """The state and length of the longest match, of a window's words at most, after reading x."""
        while state and x not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if x not in self.next[state]:
            return 0, 0
        state, n = self.next[state][x], n + 1
        if n > self.window:
            n = self.window
        while self.length[self.link[state]] >= n and state:
            state = self.link[state]
        return state, n

    def hits(self, words: bs.Words) -> Iterator[tuple[int, int, int, set]]:
        """(document, first word, one past the last, items) of every window found."""
        if not len(self.vocabulary) or not len(words):
            return
        code = np.searchsorted(self.vocabulary, words.hash)
        known = self.vocabulary[np.minimum(code, len(self.vocabulary) - 1)] == words.hash
        begin = known.copy()
        begin[1:] &= ~(known[:-1] & (words.doc[1:] == words.doc[:-1]))
        begin, n = np.flatnonzero(begin), len(known)
        final = known.copy()
        final[:-1] &= ~(known[1:] & (words.doc[1:] == words.doc[:-1]))
        stop = np.flatnonzero(final) + 1
        long = stop - begin >= self.least
        for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
            state, n = 0, 0
            for i, x in enumerate(code[a:b].tolist(), a):
                state, n = self.step(state, n, x)
                if n == self.window:
                    yield int(words.doc[a]), i + 1 - n, i + 1, self.ends.get(state, set())
                if self.short:
                    s = state
                    while s > 0:
                        for size, item in self.short.get(s, ()):
                            if size <= n:
                                yield int(words.doc[a]), i + 1 - size, i + 1, {item}
                        s = self.link[s]


def _automata(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """One automaton for each block of the benchmark; a block of it is collected at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).head()[0] or 0
    blocks = max(1, -(-int(size) // block_words))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toArrow()
        own = []
        for part in bs.slices(rows.column("text")):
            words = bs.Words(part[1], part[2], bs.NOT_ALNUM)
            bound = np.searchsorted(words.doc, np.arange(len(part[0]) + 1))
            own += [(rows.column("item_id")[r].as_py(), words.hash[bound[i] : bound[i + 1]]) for i, r in enumerate(part[0])]
        yield Automaton(sorted(own, key=lambda x: (x[0] or "", len(x[1]))), window)


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, names: tuple[str, str, str] = ("n_words", "hit_words", "item_ids")) -> DataFrame:
    """The documents with n_words, ``hit_words`` (indices of the words hit, ascending) and ``item_ids``."""
    spark = docs.sparkSession
    schema = plus(docs.schema, *zip(names, ("long", "array<int>", "array<string>"), strict=True))
    out = docs
    for k, automaton in enumerate(_automata(benchmark, window, block_words)):
        shared = spark.sparkContext.broadcast(automaton)
        text = out.columns.index("text")

        def run(batch: pa.RecordBatch, shared=shared, text=text, more=k > 0) -> Iterator[dict]:
            automaton = shared.value
            for rows, data, offs in bs.slices(batch.column(text)):
                words = bs.Words(data, offs, bs.NOT_ALNUM)
                count = words.per_doc()
                first = np.concatenate([[0], np.cumsum(count)])
                hit = [set() for _ in rows]
                items = [set() for _ in rows]
                own = batch.slice(rows.start, len(rows))
                if more:
                    hit = [set(x) for x in own.column(names[1]).to_pylist()]
                    items = [set(x) for x in own.column(names[2]).to_pylist()]
                for doc, a, b, found in automaton.hits(words):
                    hit[doc].update(range(a - int(first[doc]), b - int(first[doc])))
                    items[doc].update(x for x in found if x is not None)
                yield through(own, {names[0]: count, names[1]: pa.array([sorted(x) for x in hit], pa.list_(pa.int32())), names[2]: pa.array([sorted(x) for x in items], pa.list_(pa.string()))})

        out = map_arrow(out, run, schema)
        if k % 4 == 3:
            out = cut(out)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, window: int = WINDOW) -> DataFrame:
    """The documents without the spans hit: from the first to the last word of each run of hit words.

    A text that would lose more than ``max_coverage`` of its words is left out whole. ``n_chars``, where the
    table has it, follows the text. Other columns pass through, whatever their names.
    """
    return packed(docs, lambda own: _removed(own, benchmark, max_coverage, window))


def _removed(docs: DataFrame, benchmark: DataFrame, max_coverage: float, window: int) -> DataFrame:
    names = ("_n_words", "_hit_words", "_item_ids")
    found = match(docs, benchmark, window, names=names)
    # written out, or each task would hold two Python workers
    found = cut(found.where(F.size(names[1]) <= max_coverage * F.col(names[0])))
    text, at = found.columns.index("text"), found.columns.index(names[1])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, data, offs in bs.slices(batch.column(text)):
            own = batch.slice(rows.start, len(rows))
            hit = own.column(at).to_pylist()
            new = own.column(text).to_pylist()
            if any(hit):
                words = bs.Words(data, offs, bs.NOT_ALNUM)
                first = np.concatenate([[0], np.cumsum(words.per_doc())])
                for i, x in enumerate(hit):
                    if x:
                        gone = np.zeros(int(offs[i + 1] - offs[i]), bool)
                        for run_ in np.split(np.array(x), np.flatnonzero(np.diff(x) > 1) + 1):
                            gone[words.start[first[i] + run_[0]] - offs[i] : words.end[first[i] + run_[-1]] - offs[i]] = True
                        new[i] = data[offs[i] : offs[i + 1]][~gone].tobytes().decode()
            yield through(own, {"text": pa.array(new, pa.string())})

    order = [F.col(c) for c in docs.columns]
    out = map_arrow(found, run, plus(found.schema, ("text", "string"))).select(*order)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))) if "n_chars" in out.columns else out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op5: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = match(docs.select("doc_id", "text"), benchmark)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), worded AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low
), lens AS (SELECT DISTINCT least(len(w), 10) AS l FROM worded WHERE kind = 'i' AND len(w) > 0),
windows AS (
  SELECT DISTINCT id AS item, least(len(w), 10) AS l, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM worded WHERE kind = 'i' AND len(w) > 0)
), spots AS (
  SELECT id, l, k, array_to_string(w[k : k + l - 1], ' ') AS s
  FROM (SELECT id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM worded CROSS JOIN lens WHERE kind = 'd' AND len(w) >= l)
), found AS (SELECT spots.id, spots.l, k, item FROM spots JOIN windows ON spots.l = windows.l AND spots.s = windows.s),
hit AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(k, k + l)) AS p FROM found) GROUP BY id),
items AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM found) GROUP BY id)
SELECT d.id AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM worded d LEFT JOIN hit ON hit.id = d.id LEFT JOIN items ON items.id = d.id WHERE d.kind = 'd'
"""
