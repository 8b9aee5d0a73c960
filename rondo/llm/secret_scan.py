"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern: the three base kinds (an assigned value, an access key, a long hex run) and
a fourth, ``opaque``: a run of 20 or more characters of ``[A-Za-z0-9+/_-]`` with lower case, upper case and
digits, as keys and tokens are written. The hash of each candidate value is aggregated over the corpus by
distinct repositories (here a source and language) and owners (a source). A value that more than MAX_OWNERS
owners or more than MAX_REPOSITORIES repositories have is a widely copied example; any other is owner-specific and looks live. Base matches are always
reported; opaque ones only if they look live, as added spans.

Positions come from the pieces between the matches: their lengths, summed in a window over the matches of one
text and kind, are the offsets in code points.

Defined cases: null and empty texts have no matches; a null source is an owner of its own name ''; the rows of
one id and text have the same spans, found once and reported for each row, and the owners of all of them count; a null id is treated like any other value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.llm.common import cut

MAX_OWNERS = 3
MAX_REPOSITORIES = 6
#: Fixed patterns of the contract; letters of the key words in either case.
_WORDS = "|".join(["password", "passwd", "secret", "token", "api_?key"])
_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _WORDS)
KINDS = {
    "assign": f"({_ANY_CASE})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "opaque": "[A-Za-z0-9+/_-]{20,}",
}


def _found(kind: int, pattern: str) -> Column:
    """Every match of one kind: (kind, i, before, size, value, fits)."""
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else whole

    def fits(match: Column, own: Column) -> Column:
        if kind == 0:
            return F.length(own) >= 6
        if kind == 1:
            return F.length(match) >= 20
        return F.lit(True) if kind == 2 else own.rlike("[a-z]") & own.rlike("[A-Z]") & own.rlike("[0-9]")

    zipped = F.arrays_zip(whole.alias("match"), value.alias("value"))
    structs = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("before"), F.length(x["match"]).alias("size"),
            F.sha2(x["value"], 256).alias("value"), fits(x["match"], x["value"]).alias("fits"),
        ),
    )
    return F.when(text.rlike(pattern), structs)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, kind, start, end, value) of every candidate that fits its kind; rows of one id and text give theirs once."""
    slim = docs.select("doc_id", "tk", F.explode("found").alias("x"))
    rows = slim.select("doc_id", "tk", "x.*").dropDuplicates(["doc_id", "tk", "kind", "i"])
    ordered = Window.partitionBy("doc_id", "tk", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(ordered)).where("fits")
    return rows.withColumn("start", F.col("end") - F.col("size")).drop("before", "size", "fits", "i")


def ownership(docs: DataFrame) -> DataFrame:
    """(value, owners, repositories): how many distinct ones have each candidate value, of all rows, repeated ones too."""
    rows = docs.select("owner", "repository", F.explode(F.filter("found", lambda x: x["fits"])).alias("x"))
    once = rows.select(F.col("x.value").alias("value"), "owner", "repository").distinct()
    return once.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """op6: one row a document: counts and digest of the base spans, all spans, live and example counts."""
    found = F.filter(F.concat(*[F.coalesce(_found(k, p), F.array().cast(_TYPE)) for k, p in enumerate(KINDS.values())]), lambda x: x["kind"] >= 0)
    text = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(owner), F.lit("")).alias("owner"),
        F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in repository]).alias("repository"),
    )
    slim = cut(text.select("doc_id", F.xxhash64("text").alias("tk"), "owner", "repository", found.alias("found")))
    some = slim.where(F.size("found") > 0)
    rows = candidates(some)
    # written out, so that the join is of two plain shuffles, of which Spark splits a hot value
    rows = rows.join(cut(ownership(some)), "value").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    rows = rows.where((F.col("kind") < 3) | F.col("live"))
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    per_doc = rows.groupBy("doc_id", "tk").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS) if name != "opaque"],
        F.count_if((F.col("kind") < 3) & F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), spans.alias("spans"),
    )
    said = lambda kept: F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    out = slim.select(F.col("doc_id").alias("id"), F.col("tk").alias("key")).join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("key")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("id").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(F.coalesce(said(F.filter("spans", lambda x: x["kind"] < 3)), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(said(F.col("spans")), F.lit("")).alias("spans"), zero("n_live"), zero("n_example"),
    )


_TYPE = "array<struct<kind: int, i: int, before: int, size: int, value: string, fits: boolean>>"


def _sql(kind: int, name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract_all(text, '{quoted}', 2)" if kind == 0 else f"regexp_extract_all(text, '{quoted}')"
    fits = ["length(v) >= 6", "length(v) >= 20", "true", "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"][kind]
    return f"""SELECT rid, source, lang, {kind} AS kind, '{name}' AS name, v, i, length(m) AS size, {fits} AS fits,
  sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM (
  SELECT rid, source, lang, unnest({value}) AS v, unnest(regexp_extract_all(text, '{quoted}')) AS m, unnest(range(len(regexp_extract_all(text, '{quoted}')))) AS i,
    unnest(list_slice(string_split_regex(text, '{quoted}'), 1, len(regexp_extract_all(text, '{quoted}')))) AS p FROM dd WHERE regexp_matches(text, '{quoted}'))"""


ORACLE = (
    "WITH dd AS (SELECT row_number() OVER () AS rid, * FROM documents), f AS (SELECT * FROM (" + " UNION ALL ".join(_sql(k, name, p) for k, (name, p) in enumerate(KINDS.items())) + ") WHERE fits)"
    + f""", o AS (SELECT v, count(DISTINCT coalesce(source, '')) <= {MAX_OWNERS} AND count(DISTINCT coalesce(source, '') || '/' || coalesce(lang, '')) <= {MAX_REPOSITORIES} AS live FROM f GROUP BY v),
r AS (SELECT f.*, live, name || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS said FROM f JOIN o USING (v) WHERE kind < 3 OR live),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  string_agg(said, ',' ORDER BY stop - size, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY stop - size, kind) AS spans,
  count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM r GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example FROM dd LEFT JOIN g USING (rid)"""
)
