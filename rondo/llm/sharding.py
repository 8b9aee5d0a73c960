"""Sharding by sampled splitters under the ``bytes`` law, in DataFrame operations only.

Records are ordered by a key: the md5 of the text, then the md5 of the id and the id. Size-weighted samples
of the key, as many as MAX_RANGES ranges ask for at most, give quantile boundaries; records are range-partitioned by
them, and a range that comes out overfull is subdivided in equal parts of its key interval, of which a larger input
has more. Running sums of sizes inside the parts, of the parts' sums inside a range, and of the ranges' sums give
every record its byte offset in that order; the shard is the eighth of all bytes in which its offset lies, the slot
its place in the shard.

Copies of a text have equal keys, so they are neighbours. A group of up to a hundredth of a shard stays in the
shard where it begins; a larger one (there are at most 100 per shard) may be cut, so a hot text doesn't
unbalance the shards. A group of many rows, large or not, is dealt to several parts by the id, so no task holds it whole. The
result depends on the order only, not on the sample.

Defined cases: a null text has the size 1, crc32 0 and groups with the empty text; a null id sorts as an
empty string; repeated rows get a slot each; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rondo.llm.common import cut

SHARDS = 8
#: A group of copies of at most this share of a shard is not cut.
WHOLE = 100
ROWS_PER_RANGE = 100_000
SAMPLES_PER_RANGE = 20
MAX_RANGES = 2048
#: A group of more rows than this share of all has ranges of its own.
HOT_SHARE = 1 << 14
_BUCKET_BITS = 12
_KEY_BITS = 60


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _number(text).alias("key"),
        _number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("own"),
    )


def _ranges(rows: DataFrame, n: int, total: int, hot: list[int]) -> DataFrame:
    """Adds ``range``: the number of the sampled range that holds (key, tie); each ``hot`` key is apart from others."""
    spark = rows.sparkSession
    wanted = min(MAX_RANGES, max(32, -(-n // ROWS_PER_RANGE)))
    draw = F.pmod(F.xxhash64("own", "key", F.lit("draw")), F.lit(1 << 53)) / float(1 << 53)
    sample = rows.where(draw < F.col("size") * (wanted * SAMPLES_PER_RANGE / max(1, total))).select("key", "tie")
    # about SAMPLES_PER_RANGE rows a range, of MAX_RANGES ranges at most
    drawn = sorted((r["key"], r["tie"]) for r in sample.collect())
    splits = {drawn[len(drawn) * k // wanted] for k in range(1, wanted)} if drawn else set()
    splits = sorted(splits.union((k + end, 0) for k in hot for end in (0, 1)))
    width = 1 << (_KEY_BITS - _BUCKET_BITS)
    keys = [k for k, _ in splits]
    buckets = [(b, bisect_left(keys, b * width), [(k, t) for k, t in splits[bisect_left(keys, b * width) : bisect_right(keys, (b + 1) * width - 1)]]) for b in range(1 << _BUCKET_BITS)]
    # a table of 2**_BUCKET_BITS rows and the splitters: what lies below a bucket, and the splitters in it
    table = spark.createDataFrame(buckets, T._parse_datatype_string("bucket long, below int, inside array<struct<key: long, tie: long>>"))
    rows = rows.withColumn("bucket", F.shiftright("key", _KEY_BITS - _BUCKET_BITS)).join(F.broadcast(table), "bucket")
    passed = F.size(F.filter("inside", lambda s: (s["key"] < F.col("key")) | ((s["key"] == F.col("key")) & (s["tie"] <= F.col("tie")))))
    return rows.withColumn("range", F.col("below") + passed).drop("bucket", "below", "inside")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """op4: (doc_id, size, text_crc32, law, shard, slot, grown_shard), law ``bytes``."""
    rows = cut(keyed(docs))
    n, total = rows.agg(F.count("*"), F.sum("size")).head()
    total = total or 0
    # by bytes a group is cut over shards; by rows it is dealt to several parts, in ranges of its own
    large, many = F.col("bytes") * shards * WHOLE > total, F.col("rows") > max(ROWS_PER_RANGE, n // HOT_SHARE)
    hot = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where(large | many).select("key", large.alias("large")).collect()
    table = rows.sparkSession.createDataFrame([tuple(x) for x in hot], "key long, large boolean")  # shards * WHOLE and HOT_SHARE rows at most
    rows = rows.join(F.broadcast(table), "key", "left").withColumn("tie", F.when(F.col("large").isNotNull(), F.col("own")).otherwise(F.lit(0)))
    rows = _ranges(rows, n, total, [x["key"] for x in hot])
    # overfull ranges are cut into equal parts of their interval of keys (of ties, where the key is one)
    full = rows.groupBy("range").agg(F.count("*").alias("rows"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("tie").alias("t0"), F.max("tie").alias("t1"))
    full = full.withColumn("parts", F.ceil(F.col("rows") / (2 * ROWS_PER_RANGE)))
    at = F.when(F.col("k1") > F.col("k0"), (F.col("key") - F.col("k0")) / (F.col("k1") - F.col("k0"))).when(F.col("t1") > F.col("t0"), (F.col("tie") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(F.lit(0.0))
    rows = rows.join(F.broadcast(full), "range").withColumn("part", F.least(F.floor(at * F.col("parts")), F.col("parts") - 1)).drop("rows", "k0", "k1", "t0", "t1", "parts")
    rows = cut(rows)
    cells = rows.groupBy("range", "part").agg(F.count("*").alias("cell_rows"), F.sum("size").alias("cell_bytes"))
    # two levels of running sums: over the ranges, one row each, and over the parts of a range
    sums = cells.groupBy("range").agg(F.sum("cell_rows").alias("rows"), F.sum("cell_bytes").alias("bytes"))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("range", upto("rows", Window.orderBy("range")).alias("rows"), upto("bytes", Window.orderBy("range")).alias("bytes"))
    own = Window.partitionBy("range").orderBy("part")
    cells = cells.join(F.broadcast(sums), "range").select("range", "part", (F.col("rows") + upto("cell_rows", own)).alias("row0"), (F.col("bytes") + upto("cell_bytes", own)).alias("byte0"))
    inside = Window.partitionBy("range", "part").orderBy("key", "own", "doc_id")
    rows = rows.join(cells, ["range", "part"])
    rows = rows.withColumn("place", F.col("row0") + F.row_number().over(inside) - 1).withColumn("start", F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.withColumn("first", F.min("start").over(Window.partitionBy("range", "part", "key", "tie")))
    rows = cut(rows.select("doc_id", "size", "text_crc32", "key", "large", "place", "start", "first"))
    # where a group that is not cut over shards lies in several parts, its first start is that of all of them
    begin = rows.where("NOT large").groupBy("key").agg(F.min("start").alias("begin"))
    rows = rows.join(F.broadcast(begin), "key", "left")  # HOT_SHARE rows at most
    whole = F.when(F.col("large"), F.col("start")).otherwise(F.coalesce("begin", "first"))
    rows = rows.withColumn("shard", F.least(F.floor(whole * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int"))
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "place")
    firsts = rows.groupBy("shard").agg(F.min("place").alias("place0"))
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("place0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


ORACLE = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), d AS (
  SELECT doc_id, (length(h) / 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    ('0x' || substr(md5(text), 1, 15))::BIGINT AS key, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS own
  FROM t CROSS JOIN crc
), s AS (
  SELECT *, sum(size) OVER (ORDER BY key, own, doc_id ROWS UNBOUNDED PRECEDING) - size AS start, row_number() OVER (ORDER BY key, own, doc_id) AS place,
    sum(size) OVER (PARTITION BY key) AS bytes, sum(size) OVER () AS total FROM d
), g AS (SELECT *, min(start) OVER (PARTITION BY key) AS first FROM s),
p AS (SELECT *, least(floor((CASE WHEN bytes * {SHARDS} * {WHOLE} > total THEN start ELSE first END) * {SHARDS} / total), {SHARDS - 1})::INTEGER AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
