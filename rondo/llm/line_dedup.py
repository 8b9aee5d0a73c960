"""Line dedup by a suffix array over line-id sequences, in DataFrame operations only.

A text is its ``\\n``-split lines, a line's id two hashes of it, its position (doc_id, line number). Prefix doubling
ranks the suffixes that begin at repeated lines: level 0 by the id of the first line, level j+1 by the ranks of level j
at i and at i + 2**j. Equal suffixes up to 2**j lines have one rank, and ranks keep the order, so the positions by
rank are the suffix array, and those of one rank an interval of it with a common prefix of 2**j lines. Positions
alone in their interval drop out: no repeated run goes on there.

A line goes if a run of lines that holds it, of any number of lines and of MIN_CHARS characters at least, also begins
at an earlier position; so the first copy of each maximal repeated run stays and later copies are deleted. Such a
run is covered by the shortest runs of MIN_CHARS characters that begin or end at its lines, so the intervals of
these common prefixes, two for each line at most, decide: suffixes with a common prefix of w lines, 2**j <= w <
2**(j+1), have equal ranks of level j at its first and its last 2**j lines. Levels go on until no interval has two
positions.

Only repeated lines are kept after level 0, and of them only stretches of MIN_CHARS characters. Counts and first
positions are aggregated before the shuffle and written out, so that the join that brings ranks back is one of
two plain shuffles, of which Spark splits a hot line.

Defined cases: null and empty texts are kept as they are; rows with a null id are never changed; rows of one id and
equal texts are one row; rows of one id and different texts lose what is theirs, and share positions, so the same
line number in both is no repetition; empty lines are lines of no characters. Other columns pass through,
``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.llm.common import cut, packed

MIN_CHARS = 120
_LINE = 10**9
_ROW = ("doc_id", "_text")


def _text_key() -> Column:
    return F.xxhash64("text").alias("_text")


def _pos(i: str) -> Column:
    return (F.col("doc_id").cast("decimal(38,0)") * _LINE + F.col(i)).cast("decimal(38,0)").alias("pos")


def _lines(docs: DataFrame) -> DataFrame:
    hashed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), F.length(x).alias("chars")))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", _text_key(), F.posexplode(hashed).alias("i", "x"))
    return rows.select(*_ROW, "i", "x.a", "x.b", "x.chars", _pos("i"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows whose (a, b) stands at two positions or more, with its ``rank`` in the order of (a, b) and its ``first`` position."""
    intervals = rows.groupBy("a", "b").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first < last").drop("last")
    intervals = cut(intervals.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()))
    return rows.join(intervals, ["a", "b"]).drop("a", "b")


def _stretches(lines: DataFrame, min_chars: int) -> DataFrame:
    """Repeated lines next to each other, of ``min_chars`` characters together, with the bounds of their shortest runs.

    ``to`` is the line after the run that begins at line ``i``, ``since`` the first line of the run that ends with it.
    """
    own = Window.partitionBy(*_ROW).orderBy("i")
    rows = lines.withColumn("again", F.lag("i").over(own)).where("again IS NULL OR again < i").drop("again")  # of equal rows
    rows = rows.withColumn("stretch", F.col("i") - F.row_number().over(own))
    whole = Window.partitionBy(*_ROW, "stretch")
    rows = rows.withColumn("upto", F.sum("chars").over(whole.orderBy("i"))).withColumn("all", F.sum("chars").over(whole)).withColumn("final", F.lead("i").over(whole.orderBy("i")).isNull())
    rows = rows.where(F.col("all") >= min_chars)
    # a row for each line, and one for the place behind a stretch
    line = F.struct("i", (F.col("upto") - F.col("chars")).alias("before"), "pos", "rank", "first", "chars")
    none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("pos", "rank", "first", "chars")]
    end = F.struct((F.col("i") + 1).alias("i"), F.col("upto").alias("before"), *none)
    rows = rows.select(*_ROW, "stretch", F.explode(F.when(F.col("final"), F.array(line, end)).otherwise(F.array(line))).alias("x")).select(*_ROW, "stretch", "x.*")
    far = lambda order: whole.orderBy(order).rangeBetween(Window.unboundedPreceding, -min_chars)
    return rows.withColumn("to", F.min("i").over(far(F.col("before").desc()))).withColumn("since", F.max("i").over(far(F.col("before")))).drop("stretch", "before")


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, _text, _gone_lines): the numbers of the lines to delete, for documents that have any."""
    lines = cut(_stretches(_ranked(_lines(docs)), min_chars))
    ahead = lines.where("rank IS NOT NULL AND to IS NOT NULL").select(*_ROW, F.col("i").alias("start"), (F.col("to") - F.col("i")).alias("size"))
    behind = lines.where("since IS NOT NULL").select(*_ROW, F.col("since").alias("start"), (F.col("i") - F.col("since")).alias("size"))
    runs = ahead.unionByName(behind).distinct().select("*", _pos("start"))
    most = runs.agg(F.max("size")).head()[0] or 0
    now = lines.where("rank IS NOT NULL").select(*_ROW, "i", "pos", "rank", "first", "chars", F.col("chars").alias("head"), F.col("chars").alias("tail"))
    found = now.where((F.col("chars") >= min_chars) & (F.col("first") < F.col("pos"))).select(*_ROW, F.col("i").alias("start"), F.lit(1).alias("size"))
    size = 1
    while size <= most and not now.isEmpty():
        own = runs.where((F.col("size") > 1) & (F.col("size") >= size) & (F.col("size") < 2 * size)).withColumn("last", F.col("start") + F.col("size") - size)
        own = own.join(now.select(*_ROW, F.col("i").alias("start"), F.col("rank").alias("a")), [*_ROW, "start"])
        own = cut(own.join(now.select(*_ROW, F.col("i").alias("last"), F.col("rank").alias("b")), [*_ROW, "last"]))
        interval = cut(own.groupBy("size", "a", "b").agg(F.min("pos").alias("first"), F.max("pos").alias("end")).where("first < end").drop("end"))
        found = found.unionByName(own.join(interval, ["size", "a", "b"]).where("first < pos").select(*_ROW, "start", "size"))
        after = now.select(*_ROW, (F.col("i") - size).alias("i"), F.col("rank").alias("b"), F.col("chars").alias("more"), F.col("tail").alias("end"))
        pairs = now.join(after, [*_ROW, "i"]).select(*_ROW, "i", "pos", F.col("rank").alias("a"), "b", (F.col("chars") + F.col("more")).alias("chars"), "head", F.col("end").alias("tail"))
        # a part of a shortest run falls below min_chars without its first or its last line
        now = cut(_ranked(cut(pairs.where(F.col("chars") - F.greatest("head", "tail") < min_chars))))
        size *= 2
    reach = F.coalesce(F.max(F.col("start") + F.col("size")).over(Window.partitionBy(*_ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = found.withColumn("from", F.greatest("start", reach)).where("from < start + size")
    gone = spans.select(*_ROW, F.explode(F.sequence("from", F.col("start") + F.col("size") - 1)).alias("line"))
    return gone.groupBy(*_ROW).agg(F.collect_list("line").alias("_gone_lines"))


def _cleaned(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents with ``_gone_lines`` (null if none) and ``_kept_text``, the array of the lines that stay."""
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone_lines")
    kept = F.when(F.col("_gone_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))
    return docs.withColumn("_text", _text_key()).join(gone.hint("shuffle_hash"), list(_ROW), "left").drop("_text").withColumn("_kept_text", kept)


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with repeated runs deleted; one whose every word went is left out. Other columns pass through, whatever their names."""
    return packed(docs, _deduped)


def _deduped(docs: DataFrame) -> DataFrame:
    found = _cleaned(docs, repeated_runs(docs))
    found = found.where(F.col("_gone_lines").isNull() | F.col("_kept_text").rlike("[^\\x20\\x09-\\x0D]"))
    cols = [F.col("_kept_text").alias("text") if c == "text" else F.when(F.col("_gone_lines").isNull(), F.col(c)).otherwise(F.length("_kept_text")).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return found.select(*cols)


def report(docs: DataFrame) -> DataFrame:
    """op10: (doc_id, n_lines, n_removed, n_kept_chars, kept_sha256) of every document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = _cleaned(docs, repeated_runs(docs))
    return found.select(
        "doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.length("_kept_text").cast("long").alias("n_kept_chars"), F.sha2("_kept_text", 256).alias("kept_sha256"),
    )


ORACLE = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i, length(unnest(lines)) AS n FROM d),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
w AS (SELECT x.doc_id, x.i, y.i AS e, x.lines[x.i : y.i] AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= {MIN_CHARS} AND (y.upto - y.n - x.upto + x.n < {MIN_CHARS} OR y.upto - x.upto < {MIN_CHARS})),
f AS (SELECT *, min(doc_id::HUGEINT * 1000000000 + i) OVER (PARTITION BY b) AS name FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM f WHERE name < doc_id::HUGEINT * 1000000000 + i), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, len(lines) AS n, coalesce(len(gone), 0) AS m, array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_lines, m::BIGINT AS n_removed, length(coalesce(kept, ''))::BIGINT AS n_kept_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM k"""
