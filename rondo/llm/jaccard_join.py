"""Grouped prefix join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A set is the distinct ``SHINGLE``-word shingles of a text, A-Z in lower case, as 64-bit hashes in one global
order: shingles seen often come last, then by hash. The first shingle that two similar sets share stands among the
first ``n - ceil(0.8 n) + 1`` of either (its prefix), and in the smaller set even among the first ``n / 9``.

1. Equal sets are one *node*, however many copies there are. Nodes of identical prefix and size are a group: its
   key stands beside the prefix shingles in the postings. Only shingles found in two prefixes are posted.
2. Group pairs: in each group, and among the nodes of a size band that share a prefix shingle, the node with the
   fewest shingles of its own is the centre, and the others are verified against it. That is linear in a group
   and connects most of a family of near copies. It is done again with other centres where a shingle still has
   nodes of several components.
3. What is left is the prefix join of nodes of different components: the smaller set's first shingles meet the
   larger's prefix, and a pair must pass size, place and bitmap bounds before it leaves the join. On shingles of many nodes only
   those meet that have the same large passages, as similar sets must.
4. Pairs are expanded to their members' sets and verified by the exact intersection of all 64 bits.

So every similar pair is either verified, or inside one component of verified links: the components are exact. Of
nodes to verify only one text is moved, and its set is made again where it is met.

Defined cases: a null or wordless text has no shingles and is linked with nothing, its component its own id; a
text of one to four words has one shingle, the whole sequence; null ids are never a component's name unless
it has no other; repeated rows are rows of equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.llm import bytescan as bs
from rondo.llm.common import Counter64, KeyFilter, cut, map_arrow, map_arrow_all, packed
from rondo.llm.components import components

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Shingles counted this often are ordered by frequency; the list is held to MAX_FREQUENT by doubling this.
FREQUENT = 8
MAX_FREQUENT = 1 << 21
#: Beyond this many nodes of a shingle, other centres are tried and pairs must pass the bitmaps inside the join.
HOT = 32


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    words = bs.Words(data, offs)
    count = words.per_doc()
    first = np.concatenate([[0], np.cumsum(count)])
    grams, at = bs.ngrams(words.hash, words.doc, size)
    bound = np.searchsorted(words.doc[at], np.arange(len(count) + 1))
    out = []
    for i, n in enumerate(count):
        if n >= size:
            out.append(bs.distinct(grams[bound[i] : bound[i + 1]]))
        elif n:
            whole, _ = bs.ngrams(words.hash[first[i] : first[i + 1]], np.zeros(n, int), int(n))
            out.append(bs.mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> int:
    """64 bits of the whole set; 0 for the empty one."""
    if not len(shingles):
        return 0
    total = np.add.reduce(bs.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(shingles))
    return int(bs.mix(np.array([total]))[0].view(np.int64)) or 1


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _texts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, range, list[np.ndarray]]]:
    for batch in batches:
        for rows, data, offs in bs.slices(batch.column(text)):
            yield batch, rows, shingle_sets(data, offs)


#: 64-bit words of a node's bitmap.
BITMAP = 16


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    flags = np.zeros(64 * BITMAP, bool)
    flags[(shingles & np.uint64(64 * BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64)


def _may_reach(pairs: DataFrame, bitmaps: DataFrame, percent: Column | int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a similarity of ``percent``.

    A bit that differs stands for a shingle that one set has alone, at least, so this bounds the intersection
    from above and drops no pair that reaches it; it moves 128 bytes a node in place of its set.
    """
    side = lambda x: bitmaps.select(F.col("node").alias(x), F.col("n").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits"))
    both = pairs.withColumn("percent", F.lit(percent) if isinstance(percent, int) else percent).join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    total = F.col("a_size") + F.col("b_size")
    fits = (F.col("percent") + 100) * (total - apart) >= 2 * F.col("percent") * total
    return both.where(fits).select("a", "b")


def scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, node, bits) of every document; (key, seen) of the shingles that a task meets twice or more, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        met = Counter64(least=2)

        def rows(many: int, **columns) -> dict:
            return {k: columns.get(k, pa.nulls(many)) for k in ("doc_id", "text_key", "n", "node", "bits", "key", "seen")}

        for batch, at, sets in _texts(batches, 2):
            doc_id, text_key = (batch.column(k).slice(at.start, len(at)) for k in (0, 1))
            yield rows(len(at), doc_id=doc_id, text_key=text_key, n=[len(x) for x in sets], node=[signature(x) for x in sets], bits=[_bitmap(x) for x in sets])
            for x in met.add(np.concatenate(sets)):
                yield rows(len(x["n"]), key=x["key"], seen=x["n"])
        for x in met.flush():
            yield rows(len(x["n"]), key=x["key"], seen=x["n"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    both = cut(map_arrow_all(rows, run, "doc_id long, text_key long, n long, node long, bits array<long>, key long, seen long"))
    return both.where("node IS NOT NULL").select("doc_id", "text_key", "n", "node", "bits"), both.where("key IS NOT NULL").select("key", "seen")


class Order:
    """The global order of shingles: (level of frequency, hash)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.level = keys[order], np.log2(counts[order]).astype(np.uint8)

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        k = prefix_length(len(shingles))
        if not len(self.keys) or not k:
            return shingles[:k]
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        level = np.where(self.keys[at] == shingles, self.level[at], 0)
        return shingles[np.argsort(level, kind="stable")[:k]]


def frequency_order(counted: DataFrame) -> Order:
    """The order by the counts of ``scanned``: enough to order shingles, and never a result."""
    counts = cut(counted.groupBy("key").agg(F.sum("seen").alias("n")).where(F.col("n") >= FREQUENT))
    least = FREQUENT
    while counts.where(F.col("n") >= least).count() > MAX_FREQUENT:
        least *= 2
    rows = counts.where(F.col("n") >= least).toArrow()
    return Order(rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy())


def postings(docs: DataFrame, order: Order) -> DataFrame:
    """(token, node, n, pos, shared, rare): the prefix shingles that two documents or more have.

    ``shared`` is how many of these the node has before this one, ``rare`` how many shingles of its prefix no other
    document has; pos -1 rows hold the hash of the whole prefix and the size, the key of a group.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)  # MAX_FREQUENT entries at most

    def prefixes(sets: list[np.ndarray]) -> list[np.ndarray]:
        return [shared.value.prefix(x) for x in sets]

    def whole(prefix: np.ndarray, n: int) -> np.ndarray:
        return np.array([signature(prefix) ^ n * 0x9E3779B9], np.int64).view(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = Counter64()
        for _, _, sets in _texts(batches, 0):
            own = prefixes(sets)
            yield from seen.add(np.concatenate(own + [whole(p, len(x)) for p, x in zip(own, sets, strict=True) if len(x)]))
        yield from seen.flush()

    twice = map_arrow_all(docs.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    twice = cut(twice)
    passes = spark.sparkContext.broadcast(KeyFilter.of(twice, "key", twice.count()))  # 2**28 bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, _, sets in _texts(batches, 0):
            out = {k: [] for k in ("token", "node", "n", "pos", "shared", "rare")}
            for x, p in zip(sets, prefixes(sets), strict=True):
                if not len(x):
                    continue
                token = np.concatenate([whole(p, len(x)), p])
                ok = passes.value.passes(token)
                if not ok.any():
                    continue
                at = np.flatnonzero(ok)
                out["token"].append(token[at].view(np.int64))
                out["pos"].append(at - 1)
                out["shared"].append(np.cumsum(at >= 1) - 1)
                rare = len(p) - int(ok[1:].sum())
                for name, v in (("node", signature(x)), ("n", len(x)), ("rare", rare)):
                    out[name].append(np.full(len(at), v, np.int64))
            if out["token"]:
                yield {k: np.concatenate(v) for k, v in out.items()}

    rows = map_arrow_all(docs.select("text"), run, "token long, node long, n long, pos int, shared int, rare int")
    return cut(rows.distinct())


def _node_texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of the nodes asked for; ``nodes`` has one document of each. A packed text takes about half the bytes of its set."""
    spark = docs.sparkSession
    one = cut(nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", F.xxhash64("doc_id").alias("key")))
    many = one.count()
    passes = spark.sparkContext.broadcast([KeyFilter.of(one, "key", many), KeyFilter.of(one, "node", many)])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        batch = batch.filter(pa.array(passes.value[0].passes(batch.column(0).to_numpy())))
        for rows, data, offs in bs.slices(batch.column(1)):
            own = np.array([signature(x) for x in shingle_sets(data, offs)], np.int64)
            ok = passes.value[1].passes(own)
            key, text = (x.slice(rows.start, len(rows)).filter(pa.array(ok)) for x in batch.columns)
            yield {"met": key, "node": own[ok], "text": text}

    found = map_arrow(docs.select(F.xxhash64("doc_id").alias("key"), "text"), run, "met long, node long, text string")
    # by node alone and never broadcast, so that the texts are dealt once, for this and what follows; met = key would be a key of the join
    return found.join(one.hint("merge"), "node").where("met ^ key = 0").dropDuplicates(["node"]).select("node", "text")


def _sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offs in bs.slices(texts):
        yield from shingle_sets(data, offs)


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with n_a, n_b and the size of their intersection; moves one text of each of their nodes, and no sets."""
    texts = _node_texts(docs, nodes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")

    def meet(batch: pa.RecordBatch) -> Iterator[dict]:
        out = {k: [] for k in ("na", "nb", "common")}
        for x, y in zip(_sets_of(batch.column(2)), _sets_of(batch.column(3)), strict=True):
            small, large = (x, y) if len(x) < len(y) else (y, x)
            for name, v in (("na", len(x)), ("nb", len(y)), ("common", int(_meet(small, large).sum()))):
                out[name].append(v)
        yield {"a": batch.column(0), "b": batch.column(1)} | out

    return cut(map_arrow(both.select("a", "b", "x", "y"), meet, "a long, b long, na long, nb long, common long"))


def _sizes_fit(n: Column, m: Column) -> Column:
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


_LINKED = f"100 * common >= {PERCENT} * (na + nb - common)"
_NEED = 100 + PERCENT  # common >= PERCENT / _NEED * (na + nb)


def _place_fits() -> Column:
    """A common shingle's places leave room for enough common ones: shared ones before it, any behind it."""
    return F.expr(f"(least(x_shared, y_shared) + least(x_n - x_pos, y_n - y_pos)) * {_NEED} >= {PERCENT} * (x_n + y_n)")


def _bits_fit() -> Column:
    """A bit that differs stands for a shingle that one set has alone, at least: this bounds the intersection from above."""
    apart = F.aggregate(F.zip_with("x_bits", "y_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    total = F.col("x_n") + F.col("y_n")
    return _NEED * (total - apart) >= 2 * PERCENT * total


def _pair(met: DataFrame) -> DataFrame:
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _unchecked(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    return pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")


def _stars(post: DataFrame, rank: Column, *by: str) -> DataFrame:
    """Each bucket's centre, the node of least rank, as x with its nodes as y that fit it by size and place."""
    columns = [c for c in post.columns if c not in ("token", "rare", "many", *by)]
    centre = post.groupBy("token", *by).agg(*[F.min_by(c, rank).alias(f"x_{c}") for c in columns], F.count("*").alias("many")).where("many > 1").drop("many")
    own = post.select("token", *by, *[F.col(c).alias(f"y_{c}") for c in columns])
    return own.join(cut(centre), ["token", *by]).where(_sizes_fit(F.col("x_n"), F.col("y_n")) & _place_fits())


def _component(post: DataFrame, comp: DataFrame) -> DataFrame:
    return post.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _several(post: DataFrame, comp: DataFrame) -> DataFrame:
    """The postings of the tokens that nodes of several components have, with their node's component and, as many, the token's nodes."""
    named = _component(post, comp)
    several = named.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("many"))
    return named.join(cut(several.where("c0 < c1").select("token", "many")), "token")


def _prefix_join(left: DataFrame, keyed: bool = False) -> DataFrame:
    """The smaller set as x, by its first shingles, and the larger as y, by its prefix: of different components, by size and place.

    With ``keyed`` they also meet by the blocks that both must have, see ``_must_share``.
    """
    columns = [c for c in left.columns if c not in ("token", "many", "rare", "own_block", "met_blocks")]
    side = lambda rows, k: rows.select("token", *(["block"] if keyed else []), *[F.col(c).alias(f"{k}_{c}") for c in columns])
    ordered = F.expr("(x_n < y_n OR (x_n = y_n AND x_node < y_node)) AND x_component != y_component")
    x, y = left.where("9 * pos <= n"), left
    if keyed:
        x, y = x.withColumn("block", F.col("own_block")), y.withColumn("block", F.explode("met_blocks"))
    return side(x, "x").join(side(y, "y"), ["token", "block"] if keyed else "token").where(ordered & _sizes_fit(F.col("x_n"), F.col("y_n")) & _place_fits())


def _must_share(docs: DataFrame, nodes: DataFrame, hot: DataFrame, order: Order) -> DataFrame:
    """(node, own_block, met_blocks): for the nodes of frequent shingles, hashes of what a partner must have too.

    Shingles that the same nodes have, such as those of one passage, are a class: a node has all of it or none. Of two linked
    sets x and y, x the smaller one, x lacks no fifth of y and y no fifth of x, and y has 5/4 of x at most. So a class of more than
    n_x / 4 shingles in either is in both: what x has of such classes, ``own_block``, y has exactly. y doesn't know n_x, which lies
    between 4/5 n_y and n_y: ``met_blocks`` are its classes of more than n_y / 4, and these with one after the other of
    those above n_y / 5, five hashes at most. Only shingles of the order that are seen HOT times are looked at, the same for all nodes:
    fewer of them make classes smaller, and the bound weaker, but lose no link.
    """
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(order.keys[order.level >= int(np.log2(HOT))])  # MAX_FREQUENT at most
    sizes = hot.select("node", "n").distinct()

    def members(batch: pa.RecordBatch) -> Iterator[dict]:
        for node, x in zip(batch.column(0).to_pylist(), _sets_of(batch.column(1)), strict=True):
            x = x[_meet(x, often.value)]
            yield {"token": x.view(np.int64), "node": np.full(len(x), node)}

    held = cut(map_arrow(_node_texts(docs, nodes, sizes), members, "token long, node long"))
    # two hashes of the set of nodes that have a shingle name its class
    classes = cut(held.groupBy("token").agg(F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")))
    weights = held.join(classes, "token").groupBy("node", "a", "b").agg(F.count("*").alias("w"))
    large = weights.join(sizes, "node").where("5 * w > n").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("a", "b", "w"))).alias("large"))
    name = lambda kept: F.xxhash64(F.transform(kept, lambda c: c["a"]), F.transform(kept, lambda c: c["b"]))
    over = lambda least: F.filter("large", lambda c: c["w"] >= least)
    quarter = F.floor(F.col("n") / 4) + 1
    steps = F.transform(F.filter("large", lambda c: c["w"] < quarter), lambda c: c["w"])
    none = F.xxhash64(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))
    made = large.select("node", name(over(quarter)).alias("own_block"), F.array_distinct(F.transform(F.concat(F.array(quarter), steps), lambda v: name(over(v)))).alias("met_blocks"))
    return sizes.select("node").join(made, "node", "left").select("node", F.coalesce("own_block", none).alias("own_block"), F.coalesce("met_blocks", F.array(none)).alias("met_blocks"))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, component) of every document, n its shingles; see the module's text."""
    nodes, counted = scanned(docs)
    bitmaps = cut(nodes.dropDuplicates(["node"]))  # one document of each node
    nodes = nodes.drop("bits")
    order = frequency_order(counted)
    post = postings(docs, order)
    # 2. stars, in every bucket, then by other centres in those of several components
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / PERCENT))).cast("int")
    rank = F.col("rare") * F.lit(1 << 40) + F.pmod("node", F.lit(1 << 40))
    met = _stars(post.withColumn("band", band), rank, "band").where("x_node != y_node")
    checked = verified(docs, bitmaps, cut(_may_reach(_pair(met), bitmaps, PERCENT)))
    links = checked.where(_LINKED).select("a", "b")
    comp = components(links)
    left = cut(_several(post, comp))
    met = _stars(left.where(F.col("many") > HOT), F.xxhash64("token", "node")).where("x_component != y_component")
    again = verified(docs, bitmaps, cut(_may_reach(_unchecked(_pair(met), checked), bitmaps, PERCENT)))
    checked = checked.unionByName(again)
    links = cut(links.unionByName(again.where(_LINKED).select("a", "b")))
    comp = components(links)
    # 3. the prefix join of what is left; bitmaps move with the nodes of frequent shingles only, where they save most
    left = _component(left.where("pos >= 0").drop("component"), comp)
    cold = _may_reach(_pair(_prefix_join(left.where(F.col("many") <= HOT))), bitmaps, PERCENT)
    hot = cut(left.where(F.col("many") > HOT))
    if hot.isEmpty():
        pairs = cold
    else:
        hot = hot.join(_must_share(docs, bitmaps, hot, order), "node").join(bitmaps.select("node", "bits"), "node")
        pairs = cold.unionByName(_pair(_prefix_join(cut(hot), keyed=True).where(_bits_fit()))).distinct()
    last = verified(docs, bitmaps, cut(_unchecked(pairs, checked)))
    more = cut(last.where(_LINKED).select("a", "b"))
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    return nodes.join(comp, "node", "left").select("doc_id", "text_key", "n", F.coalesce("component", "node").alias("component"))


def similar(docs: DataFrame) -> DataFrame:
    """op8: (doc_id, n_shingles, component_id) of every document."""
    rows = grouped(docs)
    # written out, so that the join below is one of two plain shuffles, of which Spark splits a hot component
    least = cut(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = rows.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component stays, of least id, rows without an id last, then by text; of equal rows one. Rows without words all stay. Other columns pass through, whatever their names."""
    return packed(docs, _deduped)


def _deduped(docs: DataFrame) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("key"))
    first = grouped(docs).where("n > 0").groupBy("component").agg(F.min(order).alias("first")).select("first.*")
    names = {"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "key": F.xxhash64("text")}
    rows = docs.withColumns({f"_{k}": v for k, v in names.items()})
    met = rows.join(first.select(*[F.col(k).alias(f"_{k}") for k in names]).hint("shuffle_hash"), [f"_{k}" for k in names])
    one = met.withColumn("_place", F.row_number().over(Window.partitionBy(*[f"_{k}" for k in names]).orderBy(F.lit(0)))).where("_place = 1")
    wordless = docs.where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return one.select(*docs.columns).unionByName(wordless)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), c AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r) AS component_id FROM s JOIN c ON c.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
