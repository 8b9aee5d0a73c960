"""How far the sources of a language differ in their terms: all pairs of sources, and the terms that set a source apart.

Terms are runs of letters (``A-Z`` lower-cased, and every code point from U+0080 on). A language keeps the terms that
are in MIN_DOCUMENTS of its documents or more. A group is a (lang, source) pair; group or language gives each kept
term the share ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``.

Tasks count terms and documents by group, the counts meet by (lang, source, term) and then by (lang, term), which
finds the kept ones. Kept terms are dealt into blocks of TERMS, groups into blocks of GROUPS. A tile is a dense int64
matrix of the groups of two blocks by the terms of one; it sums ``abs(p - q)`` over all of its pairs of groups by
broadcasting, and keeps the best terms of each group. The tiles' partial sums and heads are merged in Spark. A kept
term that no group of a tile has is not in the tile: it adds the same amount for each such term, once, at the end.

Defined cases: null text, lang and source read as ''; empty texts and texts without terms still make their group; an
empty table gives no rows; repeated rows count each; a language with one source has no pairs; long texts are read in
segments that end between terms; columns other than text, lang and source are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.llm.common import cut, map_arrow_all

MIN_DOCUMENTS = 30
RANKS = 50
#: Groups and terms of a tile's block; the pairs of a tile are broadcast _WIDTH terms at a time.
GROUPS, TERMS, _WIDTH = 64, 2048, 256
#: A task hands on its counts when it holds about so many of them; a text is read in segments of so many bytes.
HELD, SEGMENT = 400_000, 1 << 20
SCALE, PRIOR = 1_000_000_000, 5

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^A-Za-z\x80-\xff]")


def _segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    begin = 0
    while begin < len(text):
        gap = _BETWEEN.search(text, begin + size) if len(text) > begin + size else None
        end = gap.start() if gap else len(text)
        yield text[begin:end].lower()  # of bytes: A-Z only
        begin = end


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term, summed in tasks; every group has a row of a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count: dict[tuple, Counter] = {}
        df: dict[tuple, Counter] = {}
        size = 0

        def rows() -> Iterator[dict]:
            for (lang, source), own in count.items():
                terms, n, documents = [None, *own], [0, *own.values()], [0, *map(df[lang, source].__getitem__, own)]
                yield {"lang": pa.repeat(lang, len(n)), "source": pa.repeat(source, len(n)), "term": pa.array(terms, pa.binary()), "n": n, "df": documents}
            count.clear()
            df.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                group = (lang, source)
                own, seen = count.setdefault(group, Counter()), set()
                for part in _segments(text.as_py()):
                    words = _TERM.findall(part)
                    own.update(words)
                    seen.update(words)
                df.setdefault(group, Counter()).update(seen)
                size += len(seen)
                if size >= held:
                    size = sum(map(len, count.values()))
                    if size >= held // 2:
                        yield from rows()
                        size = 0
        yield from rows()

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = map_arrow_all(docs.select(blank("lang"), blank("source"), blank("text")), run, "lang string, source string, term binary, n long, df long")
    return rows.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "df")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / total) by long division in steps of 1000: exact while total is below 9 * 10^15."""
    rest, quotient = count + PRIOR, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // total
        rest = rest % total
    return quotient + 1


def _tile(rows: pa.Table, ranks: int) -> pa.Table:
    """Partial sums of the tile's pairs of groups, and the first terms of each group if the tile holds one block of groups."""
    lang, a, b = (rows.column(k)[0].as_py() for k in ("lang", "a", "b"))
    real = np.asarray(rows.column("term").is_valid())
    get = lambda name: rows.column(name).to_numpy()
    group, first = np.unique(get("idx"), return_index=True)
    total = get("total")[first] + PRIOR * get("v")[first]
    coded = rows.column("term").filter(pa.array(real)).combine_chunks().dictionary_encode()
    code, terms = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    count = np.zeros((len(group), len(terms)), np.int64)
    at = np.searchsorted(group, get("idx")[real])
    count[at, code] = get("n")[real]
    p = share(count, np.maximum(total, 1)[:, None])
    side = group // GROUPS
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    sums = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, len(terms), _WIDTH):
        sums += np.abs(p[left, None, k : k + _WIDTH] - p[None, right, k : k + _WIDTH]).sum(2)
    i, j = np.nonzero(group[left][:, None] < group[right][None, :])
    out = [{"i": group[left][i], "j": group[right][j], "term": pa.nulls(len(i), pa.string()), "value": sums[i, j], "present": np.full(len(i), len(terms))}]
    if a == b and terms:
        place = np.empty(len(terms), np.int64)
        place[sorted(range(len(terms)), key=lambda k: terms[k].encode())] = np.arange(len(terms))
        whole = np.zeros(len(terms), np.int64)
        whole[code] = get("lang_n")[real]
        over = p - share(whole, np.array([max(1, int(get("lang_total")[0]) + PRIOR * int(get("v")[0]))]))
        for g in range(len(group)):
            best = np.flatnonzero((count[g] > 0) & (over[g] > 0))
            best = best[np.lexsort((place[best], -over[g][best]))][:ranks]
            out.append({"i": np.full(len(best), group[g]), "j": np.full(len(best), -1), "term": [terms[k] for k in best], "value": over[g][best], "present": np.zeros(len(best), np.int64)})
    tables = [pa.table({"lang": pa.repeat(lang, len(x["i"]))} | {k: pa.array(v, _TILE.field(k).type) for k, v in x.items()}, schema=_TILE) for x in out]
    return pa.concat_tables(tables)


_TILE = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("term", pa.string()), ("value", pa.int64()), ("present", pa.int64())])


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, ranks: int = RANKS, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """op13: (lang, source, part, item, value, rank), see the module. ``groups`` is for tests; it changes no result."""
    assert groups <= GROUPS
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    word = Window.partitionBy("lang", "term")
    counted = counted.select("lang", "source", "term", "n", F.sum("df").over(word).alias("docs"), F.sum("n").over(word).alias("lang_n"), (F.min("source").over(word) == F.col("source")).alias("one"))
    kept = cut(counted.where(F.col("term").isNull() | (F.col("docs") >= min_documents)).drop("docs"))
    own = Window.partitionBy("lang")
    named = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term").isNotNull() & F.col("one")).alias("ones"))
    dims = named.select(
        "lang", "source", "total", F.sum("total").over(own).alias("lang_total"), F.sum("ones").over(own).alias("v"),
        (F.row_number().over(own.orderBy("source")) - 1).cast("long").alias("place"), F.count("*").over(own).alias("many"),
    )
    # groups are numbered so that a block of them begins at a multiple of GROUPS
    dims = dims.select(
        "lang", "source", "total", "lang_total", "v", (F.expr(f"place div {groups}") * GROUPS + F.col("place") % groups).alias("idx"),
        F.expr(f"(many + {groups - 1}) div {groups}").alias("sides"), F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).alias("blocks"),
    )
    dims = cut(dims)
    cells = kept.where("term IS NOT NULL").join(dims, ["lang", "source"]).withColumn("block", F.expr("pmod(xxhash64(term), blocks)"))
    every = dims.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    columns = ["lang", "idx", "term", "n", "lang_n", "total", "lang_total", "v", "block"]
    rows = cells.select(*columns, "sides").unionByName(every.select(*columns, "sides"))
    rows = rows.select(*columns, F.expr(f"idx div {GROUPS}").alias("own"), F.explode(F.expr("sequence(0L, sides - 1)")).alias("other"))
    rows = rows.select(*columns, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    parts = cut(rows.groupBy("lang", "a", "b", "block").applyInArrow(lambda t: _tile(t, ranks), "lang string, i long, j long, term string, value long, present long"))
    left = dims.select("lang", F.col("idx").alias("i"), "source", "total", "v")
    right = dims.select("lang", F.col("idx").alias("j"), F.col("source").alias("item"), F.col("total").alias("other_total"))
    none = lambda c: F.expr(f"1 + {SCALE * PRIOR} div greatest({c} + {PRIOR} * v, 1)")
    pairs = parts.where("j >= 0").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    pairs = pairs.select("lang", "value", "present", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")).select("lang", "value", "present", "x.*")
    pairs = pairs.join(left, ["lang", "i"]).join(right, ["lang", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("v") - F.col("present")) * F.abs(none("total") - none("other_total"))).alias("value"))
    heads = parts.where("j < 0").join(left, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    heads = heads.withColumn("rank", order).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", order).unionByName(heads)


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_ALPHABET}', '{_ALPHABET.lower()}') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n FROM g),
ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY lang),
lc AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY lang, term),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {PRIOR})) // (n.n + {PRIOR} * v.v) AS p
  FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (lc.c + {PRIOR})) // (ln.n + {PRIOR} * v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= {RANKS}"""
