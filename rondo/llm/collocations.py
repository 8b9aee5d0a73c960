"""Phrases of two to four words that stay together, mined for each language by growing frequent prefixes to the right.

Texts (``A-Z`` lower-cased) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. A
candidate is a phrase with MIN_COUNT contiguous occurrences or more. Its score is the least, over the ways to cut it
in two, of floor(2000000 a / (l + r)), with the counts of the whole and of its parts; a candidate inside a
longer one that is at least four fifths as frequent is dropped.

Tasks turn texts into chunks of word places with a table of the chunk's distinct words. The tables meet by
(lang, word): frequent words get an id, which goes back to their chunks. An occurrence of a frequent word is then a
pointer: the ids of the word and of the three after it, up to the first that isn't frequent. The pointers of a prefix go to
one task, which extends the prefix right and depth-first: a child's pointers are those of its parent that have its word
next. A prefix with more than POINTERS pointers goes to no task: Spark counts its extensions, summed in the
tasks before the shuffle, and each of these is a prefix on its own, down to phrases of four words.

Of the longer candidates that may drop one, those longer by one word decide: any other holds one of them, which is as
frequent at least and a candidate itself.

Defined cases: null lang is ``und``, null and empty texts have no words; an empty table gives no rows; repeated rows count
each; texts are read whole, in segments that end between words, whose pointers look into the next one; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.llm.common import BIG_ROWS, cut, map_arrow_all, parts_for

MIN_COUNT = 30
RANKS = 2000
#: Pointers that one prefix may bring to a task, and that a task gets on average.
POINTERS = TASK_POINTERS = 500_000
#: Bytes of text in a chunk and in a segment of a long text.
CHUNK, SEGMENT = 4 << 20, 1 << 20
LONGEST = 4

_STOPS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _STOPS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_STOPS))
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
_AHEAD = np.uint32(1 << 31)


def _tokens(segment: bytes) -> list[bytes]:
    """Words, and a line feed for each end of a piece."""
    return [w for w in segment.translate(_FOLD).replace(b"\n", b" \n ").split(b" ") if w]


def _segments(text: bytes, size: int) -> Iterator[tuple[list[bytes], bool]]:
    """Tokens of each segment and whether it is the last; the last ends a piece."""
    begin = 0
    while begin < len(text):
        gap = _GAP.search(text, begin + size) if len(text) > begin + size else None
        end = gap.start() if gap else len(text)
        own = _tokens(text[begin:end])
        yield (own, False) if gap else ([*own, b"\n"], True)
        begin = end


class _Chunk:
    """Texts of one language: the places of their words in the table of distinct ones, 0 for the end of a piece."""

    def __init__(self) -> None:
        self.table, self.places, self.size = defaultdict(count().__next__), [], 0
        self.table[b"\n"]

    def add(self, tokens: list[bytes], size: int, ahead: bool = False) -> None:
        at = np.fromiter(map(self.table.__getitem__, tokens), np.uint32, len(tokens))
        self.places.append(at | _AHEAD if ahead else at)
        self.size += size

    def row(self, lang: str, number: int) -> dict:
        at = np.concatenate(self.places)
        n = np.bincount(at[at < _AHEAD], minlength=len(self.table))[1:]
        words = pa.array(list(self.table)[1:], pa.binary()).cast(pa.string())
        edge = pa.array([0, len(words)], pa.int32())
        planes = np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4).T).tobytes()  # planes of bytes compress well
        return {"chunk": [number], "lang": [lang], "n": [int(n.sum())], "words": pa.ListArray.from_arrays(edge, words), "counts": pa.ListArray.from_arrays(edge, pa.array(n, pa.int64())), "places": [planes]}


def chunks(docs: DataFrame, size: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """(chunk, lang, n, words, counts, places) of all texts, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_: dict[str, _Chunk] = {}
        numbers = count(TaskContext.get().partitionId() << 32)

        def closed(lang: str) -> dict:
            return open_.pop(lang).row(lang, next(numbers))

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lang, scalar in zip(batch.column(0).to_pylist(), texts, strict=True):
                text = scalar.as_py()
                for k, (tokens, last) in enumerate(_segments(text, segment)):
                    own = open_.setdefault(lang, _Chunk())
                    if k and own.size >= size and (last or len(tokens) >= LONGEST - 1):  # what follows in the same text stays in sight
                        own.add(tokens[: LONGEST - 1], 0, ahead=True)
                        yield closed(lang)
                        own = open_.setdefault(lang, _Chunk())
                    own.add(tokens, min(segment, len(text)))
                if lang in open_ and open_[lang].size >= size:
                    yield closed(lang)
                if sum(x.size for x in open_.values()) >= 4 * size:
                    yield closed(max(open_, key=lambda k: open_[k].size))
        for lang in list(open_):
            yield closed(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(map_arrow_all(rows, run, "chunk long, lang string, n long, words array<string>, counts array<long>, places binary"), **BIG_ROWS)


def frequent_words(words: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, wid): the words with ``least`` occurrences or more, numbered from 1 with few gaps."""
    own = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    own = cut(own.withColumn("id", F.monotonically_increasing_id()))  # partition and place in it
    parts = (own.agg(F.max(F.shiftright("id", 33))).head()[0] or 0) + 1
    return own.withColumn("wid", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright("id", 33) + 1).drop("id")


_IDS = ["w1", "w2", "w3", "w4"]
_POINTER = ", ".join(f"{w} long" for w in _IDS)


def pointers(table: DataFrame, words: DataFrame, frequent: DataFrame, limit: int) -> DataFrame:
    """(w1, w2, w3, w4, hot): every occurrence of two frequent words or more, with 0 after the last; hot if w1 has over ``limit``."""
    answers = words.join(frequent, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "wid", (F.col("f") > limit).alias("hot"))).alias("found"))
    both = table.select("chunk", "places").join(answers.hint("shuffle_hash"), "chunk").select("places", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(len(batch)):
                raw = np.frombuffer(batch.column(0)[k].as_py(), np.uint8)
                place = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).reshape(-1)
                own, place = place < _AHEAD, place & ~_AHEAD
                found = batch.column(1)[k].values
                at, wid, hot = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                size = int(place.max(initial=0)) + 1
                ids, is_hot = np.zeros(size, np.int64), np.zeros(size, bool)
                ids[at], is_hot[at] = wid, hot
                w = np.concatenate([ids[place], np.zeros(LONGEST, np.int64)])
                begin = np.flatnonzero((w[: len(place)] > 0) & (w[1 : len(place) + 1] > 0) & own)
                for low in range(0, len(begin), 100_000):
                    i = begin[low : low + 100_000]
                    third = w[i + 2]
                    yield {"w1": w[i], "w2": w[i + 1], "w3": third, "w4": np.where(third > 0, w[i + 3], 0), "hot": is_hot[place[i]]}

    return cut(map_arrow_all(both, run, f"{_POINTER}, hot boolean"))


def _grown(w: np.ndarray, depth: int, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Every frequent phrase that extends a prefix of ``depth`` words; ``w`` holds a pointer a column. A prefix of two words or more counts, too."""
    order = np.lexsort(w[:depth][::-1])
    new = np.any(w[:depth, order[1:]] != w[:depth, order[:-1]], axis=0)
    bound = np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]])
    for k in np.flatnonzero(np.diff(bound) >= least):
        own = order[bound[k] : bound[k + 1]]
        prefix = tuple(w[:depth, own[0]].tolist())
        if depth > 1:
            yield prefix, len(own)
        yield from _extended(w, own, prefix, least)


def _extended(w: np.ndarray, own: np.ndarray, prefix: tuple[int, ...], least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    following = w[len(prefix), own]
    order = np.argsort(following, kind="stable")
    following = following[order]
    bound = np.concatenate([[0], np.flatnonzero(following[1:] != following[:-1]) + 1, [len(following)]])
    for k in np.flatnonzero(np.diff(bound) >= least):
        word = int(following[bound[k]])
        if word:
            yield (*prefix, word), int(bound[k + 1] - bound[k])
            if len(prefix) + 1 < len(w):
                yield from _extended(w, own[order[bound[k] : bound[k + 1]]], (*prefix, word), least)


def phrases(table: DataFrame, least: int = MIN_COUNT, limit: int = POINTERS) -> tuple[DataFrame, DataFrame]:
    """The frequent words (lang, word, f, wid), and the frequent phrases (w1, w2, w3, w4, f) of one to four words, 0 after the last."""
    words = table.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    words = words.select("chunk", "lang", (F.col("at") + 1).alias("at"), F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    frequent = frequent_words(words, least)
    rows = pointers(table, words, frequent, limit)
    light, heavy = [rows.where("NOT hot").select(*_IDS, F.lit(1).alias("depth"))], rows.where("hot").select(*_IDS)
    found = [frequent.select(F.col("wid").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in _IDS[1:]], "f")]
    for depth in (2, 3, 4):
        key = _IDS[:depth]
        counts = heavy.where(F.col(key[-1]) > 0).groupBy(*key).agg(F.count("*").alias("f"))
        padded = lambda df, key=key: df.select(*key, *[F.lit(0).cast("long").alias(w) for w in _IDS[len(key) :]], "f")
        if depth == LONGEST:
            found.append(counts.where(F.col("f") >= least))
            break
        hot = cut(counts.where(F.col("f") > limit))
        light.append(heavy.where(F.col(key[-1]) > 0).join(hot, key, "left_anti").select(*_IDS, F.lit(depth).alias("depth")))
        if hot.isEmpty():
            break
        found.append(padded(hot))
        heavy = cut(heavy.join(hot, key, "left_semi").select(*_IDS))
    mine = light[0]
    for x in light[1:]:
        mine = mine.unionByName(x)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [[np.asarray(x) for x in batch.columns] for batch in batches]
        if not held:
            return
        *w, depth = (np.concatenate(x) for x in zip(*held, strict=True))
        w = np.stack(w)
        for d in np.unique(depth).tolist():
            out = list(_grown(w[:, depth == d], d, least))
            ids = np.zeros((len(out), LONGEST), np.int64)
            for i, (phrase, _) in enumerate(out):
                ids[i, : len(phrase)] = phrase
            yield {name: ids[:, i] for i, name in enumerate(_IDS)} | {"f": np.array([n for _, n in out], np.int64)}

    prefix = F.xxhash64("w1", F.when(F.col("depth") >= 2, F.col("w2")).otherwise(0), F.when(F.col("depth") >= 3, F.col("w3")).otherwise(0))
    parts = parts_for(table.sparkSession, rows.count(), TASK_POINTERS)
    found.append(map_arrow_all(mine.repartition(parts, prefix), grow, f"{_POINTER}, f long"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return frequent, cut(every)


def scored(every: DataFrame) -> DataFrame:
    """(w1, w2, w3, w4, a, l, r, score) of the phrases of two words or more that no longer one covers."""
    some = every.where("w2 > 0").withColumnRenamed("f", "a")
    none = F.lit(0).cast("long")

    def way(k: int) -> Column:
        left = [F.col(w) for w in _IDS[:k]] + [none] * (3 - k)
        right = [F.col(w) for w in _IDS[k:]] + [none] * (k - 1)
        return F.when(F.col(_IDS[k]) > 0, F.struct(F.lit(k).alias("k"), *[x.alias(f"l{i + 1}") for i, x in enumerate(left)], *[x.alias(f"r{i + 1}") for i, x in enumerate(right)]))

    parts = every.where("w4 = 0")
    part = lambda s: parts.select(*[F.col(f"w{i}").alias(f"{s}{i}") for i in (1, 2, 3)], F.col("f").alias(s))
    ways = some.select(*_IDS, "a", F.explode(F.array_compact(F.array(way(1), way(2), way(3)))).alias("x")).select(*_IDS, "a", "x.*")
    ways = ways.join(part("l"), ["l1", "l2", "l3"]).join(part("r"), ["r1", "r2", "r3"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r)")  # the product may pass 64 bits
    best = ways.withColumn("score", score).groupBy(*_IDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    ends = [F.when(F.col("w4") > 0, F.struct(*[F.col(w).alias(f"s{i + 1}") for i, w in enumerate(own)])).otherwise(F.struct(F.col(own[0]).alias("s1"), F.col(own[1]).alias("s2"), none.alias("s3"))) for own in (_IDS[:3], _IDS[1:])]
    longer = some.where("w3 > 0").select("a", F.explode(F.array(*ends)).alias("x")).groupBy("x").agg(F.max("a").alias("longer"))
    longer = longer.select(F.col("x.s1").alias("w1"), F.col("x.s2").alias("w2"), F.col("x.s3").alias("w3"), none.alias("w4"), "longer")
    kept = best.join(longer, _IDS, "left").where(F.col("longer").isNull() | (F.col("longer") * 5 < F.col("a") * 4))
    return kept.select(*_IDS, "a", "best.l", "best.r", "best.score")


def mine(docs: DataFrame, least: int = MIN_COUNT, ranks: int = RANKS, limit: int = POINTERS, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """op11: (lang, rank, phrase, a, l, r, n, score), the first ``ranks`` of each language; see the module. ``limit``, ``chunk`` and ``segment`` change no result."""
    table = chunks(docs, chunk, segment)
    frequent, every = phrases(table, least, limit)
    best = cut(scored(every))
    names = best.select(F.struct(*_IDS).alias("p"), F.posexplode(F.array(*_IDS)).alias("i", "wid")).where("wid > 0").join(frequent.select("wid", "lang", "word"), "wid")
    names = names.groupBy("p").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(names.select("p.*", "lang", "phrase"), _IDS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= ranks)
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, s, count(*) AS f FROM (
  {" UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: list_slice(w, i, i + {k - 1}))) AS s FROM p WHERE len(w) >= {k}" for k in (1, 2, 3, 4))}
  ) GROUP BY lang, s HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, s, f AS a, unnest(range(1, len(s))) AS k FROM f WHERE len(s) > 1),
b AS (SELECT c.lang, c.s, c.a, min(struct_pack(score := ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT, k := c.k, l := l.f, r := r.f)) AS x
  FROM c JOIN f l ON l.lang = c.lang AND l.s = c.s[1:c.k] JOIN f r ON r.lang = c.lang AND r.s = c.s[c.k + 1:] GROUP BY c.lang, c.s, c.a),
o AS (SELECT lang, s, max(f) AS longer FROM (SELECT lang, f, unnest([s[1:len(s) - 1], s[2:]]) AS s FROM f WHERE len(s) > 2
  UNION ALL SELECT lang, f, unnest([s[1:2], s[2:3], s[3:4]]) FROM f WHERE len(s) = 4) GROUP BY lang, s)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM (SELECT lang, array_to_string(s, ' ') AS phrase, a, x.l AS l, x.r AS r, x.score AS score,
  row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, array_to_string(s, ' ')) AS rank FROM b LEFT JOIN o USING (lang, s) WHERE longer IS NULL OR 100 * longer < 80 * a)
JOIN n USING (lang) WHERE rank <= {RANKS}"""
