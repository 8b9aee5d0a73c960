"""Who owns which rows, and rewrites of labels and features; randomness is md5 of the seed and the row's id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rondo.functions.vectors import uniform


#: Rows of a part, about; the parts of a class are ordered by tasks of their own.
PART_ROWS = 200_000


def _parts(samples: DataFrame) -> int:
    """Parts of a class, if all rows were of one."""
    return max(8, -(-samples.count() // PART_ROWS))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds rank, a row's place in its class, and n, the class's rows; ``part`` of the rows (label, part) must follow the order.

    Parts are sorted each by itself; where a part begins follows from counts, a row a class and part.
    """
    own = Window.partitionBy("label")
    before = F.coalesce(F.sum("cell").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy("label", "part").agg(F.count("*").alias("cell")).select("label", "part", before.alias("before"), F.sum("cell").over(own).alias("n"))
    inside = Window.partitionBy("label", "part").orderBy(*order)
    return rows.join(F.broadcast(cells), ["label", "part"]).withColumn("rank", F.col("before") + F.row_number().over(inside)).drop("before", "part")


def shuffled(samples: DataFrame, seed: str) -> DataFrame:
    """(sample_id, label, rank, n): the place of each row in a random order of its class."""
    rows, parts = samples.select("sample_id", "label").withColumn("u", uniform(seed, "sample_id")), _parts(samples)
    return _numbered(rows.withColumn("part", F.least(F.floor(F.col("u") * parts), F.lit(parts - 1))), "u", "sample_id").drop("u")


def _in_order(samples: DataFrame) -> DataFrame:
    """The same in order of ids: parts end at quantiles of the ids, so gaps between them don't matter."""
    parts = _parts(samples)
    ends = samples.agg(F.percentile_approx("sample_id", [k / parts for k in range(1, parts)], 10_000).alias("ends"))  # one row
    part = F.size(F.filter("ends", lambda x: x < F.col("sample_id"))).cast("long")
    return _numbered(samples.select("sample_id", "label").join(F.broadcast(ends)).withColumn("part", part).drop("ends"), "sample_id")


def iid(samples: DataFrame, clients: int = 10, seed: str = "iid") -> DataFrame:
    """Equal slices of every class; what is left over is dealt from the end, one row a client."""
    rows = shuffled(samples, seed)
    per = F.floor(F.col("n") / clients)
    client = F.when(F.col("rank") <= per * clients, F.floor((F.col("rank") - 1) / per)).otherwise(F.col("n") - F.col("rank"))
    return rows.select("sample_id", "label", client.cast("int").alias("client_id"))


def dirichlet(samples: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows of a class in order of id, cut at the running shares (label, client_id, frac)."""
    own = Window.partitionBy("label")
    rows = _in_order(samples)
    upto = F.sum("frac").over(own.orderBy("client_id").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("client_id").over(own) == F.col("client_id")
    cuts = shares.withColumn("high", F.when(last, 2.0).otherwise(upto)).withColumn("low", F.coalesce(F.lag("high").over(own.orderBy("client_id")), F.lit(0.0)))
    met = rows.join(F.broadcast(cuts), "label")  # a row a class and client
    return met.where((F.col("rank") > F.floor(F.col("low") * F.col("n"))) & (F.col("rank") <= F.when(F.col("high") == 2.0, F.col("n")).otherwise(F.floor(F.col("high") * F.col("n"))))).select("sample_id", "label", "client_id")


def dirichlet_shares(spark: SparkSession, labels: int = 10, clients: int = 10, alpha: float = 0.5, seed: int = 42) -> DataFrame:
    """(label, client_id, frac): for each label a draw of Dir(alpha, ..., alpha), as many numbers as labels and clients."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    drawn = np.random.default_rng(seed).dirichlet([alpha] * clients, labels)
    return spark.createDataFrame([(k, c, float(x)) for k, row in enumerate(drawn) for c, x in enumerate(row)], "label int, client_id int, frac double")


def class_imbalanced(assignment: DataFrame, gamma: float = 0.5, classes: int = 10, seed: str = "imbalance") -> DataFrame:
    """Of class i a client keeps max(1, int(gamma ** (i / (classes - 1)) * n)) of its rows."""
    own = shuffled(assignment.select("sample_id", F.struct("client_id", "label").alias("label")), seed).select("sample_id", "label.*", "rank", "n")
    kept = F.greatest(F.lit(1), F.floor(F.pow(F.lit(gamma), F.col("label") / float(classes - 1)) * F.col("n")))
    return own.where(F.col("rank") <= kept).select("sample_id", "label", "client_id")


def split(samples: DataFrame, mode: str, **more) -> DataFrame:
    gamma = {"gamma": more.pop("gamma")} if "gamma" in more else {}
    modes = {"iid": iid, "dirichlet": dirichlet, "class-imbalanced": lambda rows, **own: class_imbalanced(iid(rows, **own), **gamma)}
    if mode not in modes:
        raise ValueError(f"unknown partition mode {mode}")
    return modes[mode](samples, **more)


def subset(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids`` (sample_id)."""
    return samples.join(ids.select("sample_id"), "sample_id", "left_semi")


def labels_of_both(assignment: DataFrame, one: int, other: int) -> DataFrame:
    """(label): those that both clients have."""
    own = lambda c: assignment.where(F.col("client_id") == c).select("label")
    return own(one).intersect(own(other))


def label_histogram(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("client_id", "label").agg(F.count("*").alias("n"))


def label_coverage(assignment: DataFrame) -> DataFrame:
    """(label, clients, everywhere): how many clients have a label, and whether all have it."""
    pairs = assignment.select("client_id", "label").distinct()
    total = assignment.agg(F.count_distinct("client_id").alias("total"))  # one row
    return pairs.groupBy("label").agg(F.count("*").alias("clients")).join(F.broadcast(total)).select("label", "clients", (F.col("clients") == F.col("total")).alias("everywhere"))


def stratified_sample(samples: DataFrame, size: int = 100, seed: str = "stratum") -> DataFrame:
    """int(n size / total) rows of each class."""
    counts = samples.groupBy("label").agg(F.count("*").alias("n"))
    quota = counts.withColumn("quota", F.floor(F.col("n") * size / F.sum("n").over(Window.partitionBy()))).select("label", "quota")  # a row a class
    return shuffled(samples, seed).join(F.broadcast(quota), "label").where("rank <= quota").select("sample_id", "label")


def mixed(poison: DataFrame, clean: DataFrame, ratio: float = 0.5, cap: int = 100, target: int = 6, seed: str = "mix") -> DataFrame:
    """(sample_id, label, kind): min(int(N ratio), cap) poisoned rows, labelled ``target``, and as many clean ones as the ratio asks for.

    N is the number of rows of both tables.
    """
    total = poison.select("sample_id").unionByName(clean.select("sample_id")).agg(F.count("*").alias("total"))
    n = F.least(F.floor(F.col("total") * ratio), F.lit(cap))
    sizes = total.select(n.alias("poison"), F.floor(n / ratio - n).alias("clean"))  # one row

    def pick(rows: DataFrame, kind: str) -> DataFrame:
        # cap and ratio bound what is taken, so a first cut by a limit sorts no whole table in one task
        most = int(cap / ratio) + 1
        first = rows.select("sample_id", "label", uniform(seed, "sample_id").alias("u")).orderBy("u", "sample_id").limit(most)
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("u", "sample_id")))
        return ranked.join(F.broadcast(sizes), F.col("rank") <= F.col(kind)).select("sample_id", "label", F.lit(kind).alias("kind"))

    return pick(poison, "poison").withColumn("label", F.lit(target)).unionByName(pick(clean, "clean"))


def rewritten_label(label: Column, mode: str, target: int = 6, source: int = 2, classes: int = 10) -> Column:
    if mode == "all2one":
        return F.lit(target)
    if mode == "all2all":
        return classes - 1 - label
    if mode == "targeted":
        return F.when(label == source, target).otherwise(label)
    if mode == "random":
        return F.floor(uniform("label", "sample_id") * classes * 0.999999).cast("int")
    raise ValueError(f"unknown label mode {mode}")


def with_trigger(samples: DataFrame, side: int = 8, top: int = -3, left: int = -3, size: int = 2, value: float = 1.0) -> DataFrame:
    """A square of the flat side x side image overwritten; negative offsets count from the far corner."""
    y0, x0 = top % side, left % side
    inside = lambda i: (F.floor(i / side) >= y0) & (F.floor(i / side) < y0 + size) & (i % side >= x0) & (i % side < x0 + size)
    return samples.withColumn("features", F.transform("features", lambda x, i: F.when(inside(i), F.lit(value)).otherwise(x)))


def with_pattern(samples: DataFrame, pattern: list[list[float]], side: int = 8, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """A pattern of pixels, normalised as the images are, written over the bottom right corner."""
    height, width = len(pattern), len(pattern[0])
    flat = F.array(*[F.lit((float(x) - mean) / sd) for row in pattern for x in row])
    y, x = lambda i: F.floor(i / side) - (side - height), lambda i: i % side - (side - width)
    cell = lambda v, i: F.when((y(i) >= 0) & (x(i) >= 0), F.get(flat, (y(i) * width + x(i)).cast("int"))).otherwise(v)
    return samples.withColumn("features", F.transform("features", cell))


def with_strips(samples: DataFrame, client: Column | None = None, side: int = 8, width: int = 2, gap: int = 2, shift: int = 0, value: float = 1.0) -> DataFrame:
    """A trigger in four strips of one row: a client writes the strip ``client % 4``; without a client all four are written."""
    row, col = lambda k: F.floor(k / 2) * (1 + gap) + shift, lambda k: k % 2 * (width + gap) + shift
    inside = lambda i, k: (F.floor(i / side) == row(k)) & (i % side >= col(k)) & (i % side < col(k) + width)
    strips = [F.lit(k) for k in range(4)] if client is None else [client % 4]

    def cell(v: Column, i: Column) -> Column:
        hit = inside(i, strips[0])
        for k in strips[1:]:
            hit = hit | inside(i, k)
        return F.when(hit, F.lit(value)).otherwise(v)

    return samples.withColumn("features", F.transform("features", cell))


def poisoned_batches(samples: DataFrame, batch: int = 16, ratio: float = 0.32, mode: str = "all2one", train: bool = True, **trigger) -> DataFrame:
    """All samples; the chosen ones of each batch, or every one in a test, get the trigger and the rewritten label."""
    chosen = batch_choice(samples, batch, ratio if train else 1.0).select("sample_id", F.lit(True).alias("poisoned"))
    rows = samples.join(chosen, "sample_id", "left").withColumn("poisoned", F.coalesce("poisoned", F.lit(False)))
    marked = with_trigger(rows.withColumn("clean", F.col("features")), **trigger)
    pick = lambda yes, no: F.when(F.col("poisoned"), yes).otherwise(no)
    return marked.select("sample_id", pick(rewritten_label(F.col("label"), mode), F.col("label")).alias("label"), pick(F.col("features"), F.col("clean")).alias("features"), "poisoned")


def normalised(samples: DataFrame, mean: float, sd: float) -> DataFrame:
    return samples.withColumn("features", F.transform("features", lambda x: (x - mean) / sd))


def normalised_by(samples: DataFrame, statistics: DataFrame, key: str = "dataset") -> DataFrame:
    """Features less the mean and over the deviation of their channel, from a table (``key``, mean, sd) of arrays; channels change fastest.

    A sample whose key isn't in the table has null features.
    """
    table = statistics.select(key, F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))
    rows = samples.join(table, key, "left")
    channel = lambda name, i: F.get(name, (i % F.size(name)).cast("int"))
    made = F.transform("features", lambda x, i: (x - channel("_mean", i)) / channel("_sd", i))
    return rows.withColumn("features", F.when(F.col("_mean").isNotNull(), made)).drop("_mean", "_sd")


def _taps(size: int, new: int) -> list[list[tuple[int, float]]]:
    """For each new place the old ones that it is made of and their shares: a triangle as wide as the step, of two old ones at least."""
    step = size / new
    reach = max(1.0, step)
    out = []
    for k in range(new):
        middle = (k + 0.5) * step
        own = [(i, 1 - abs(i + 0.5 - middle) / reach) for i in range(size)]
        own = [(i, w) for i, w in own if w > 0]
        total = sum(w for _, w in own)
        out.append([(i, w / total) for i, w in own])
    return out


def resized(features: Column | str, size: tuple[int, int], new: tuple[int, int], channels: int = 1) -> Column:
    """A flat image of ``size`` (height, width) in a new size, bilinear: between the old pixels where it grows, over all of them where it shrinks."""
    (height, width), (rows, columns) = size, new

    def taps(old: int, to: int) -> Column:
        return F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in own]) for own in _taps(old, to)])

    def total(own: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(own, F.lit(0.0), lambda s, t: s + t["w"] * value(t["i"]))

    flat = F.col(features) if isinstance(features, str) else features
    places = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    part = lambda k, by, of: (F.floor(k / by) % of).cast("int")
    across = taps(width, columns)
    wide = F.transform(places(height * columns * channels), lambda k: total(F.get(across, part(k, channels, columns)), lambda x: F.get(flat, (part(k, columns * channels, height) * width + x) * channels + k % channels)))
    down = taps(height, rows)
    made = lambda own: F.transform(places(rows * columns * channels), lambda k: total(F.get(down, part(k, columns * channels, rows)), lambda y: F.get(own, (y * columns + part(k, channels, columns)) * channels + k % channels)))
    return F.get(F.transform(F.array(wide), made), 0)  # so the first pass is made once


def with_image(samples: DataFrame, image: DataFrame, side: int = 8) -> DataFrame:
    """The picture of a one-row table (height, width, features) written over the bottom right corner of flat side x side images of one channel."""
    rows = samples.join(F.broadcast(image.select(F.col("height").alias("_height"), F.col("width").alias("_width"), F.col("features").alias("_image"))))
    y, x = lambda i: F.floor(i / side) - (side - F.col("_height")), lambda i: i % side - (side - F.col("_width"))
    cell = lambda v, i: F.when((y(i) >= 0) & (x(i) >= 0), F.get("_image", (y(i) * F.col("_width") + x(i)).cast("int"))).otherwise(v)
    return rows.withColumn("features", F.transform("features", cell)).drop("_height", "_width", "_image")


def image_trigger(images: DataFrame, size: int, height: int, width: int, channels: int = 1, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """(height, width, features) of a decoded picture: grey by the usual weights, resized to ``size`` x ``size`` and normalised."""
    shares = F.array(*[F.lit(w) for w in ((0.299, 0.587, 0.114) if channels >= 3 else (1.0,))])
    pixel = lambda k: F.aggregate(F.sequence(F.lit(0), F.size(shares) - 1), F.lit(0.0), lambda s, c: s + F.get(shares, c) * F.get("features", k * channels + c))
    grey = images.select(F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), pixel).alias("features"))
    small = grey.select(resized("features", (height, width), (size, size)).alias("features"))
    return small.select(F.lit(size).alias("height"), F.lit(size).alias("width"), F.transform("features", lambda v: (v - mean) / sd).alias("features"))


def poisoned_test(poison: DataFrame, target: int = 6) -> DataFrame:
    """(sample_id, label, kind): the test set of a mixed attack, all of its samples and no clean one, under the target's label."""
    return poison.select("sample_id", F.lit(target).alias("label"), F.lit("poison").alias("kind"))


def batch_choice(samples: DataFrame, batch: int = 16, ratio: float = 0.32, seed: str = "batch") -> DataFrame:
    """int(batch ratio) rows of each batch of consecutive ids."""
    rows = samples.select("sample_id", "label", F.floor(F.col("sample_id") / batch).alias("batch"))
    own = Window.partitionBy("batch")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(uniform(seed, "sample_id"), "sample_id"))).withColumn("n", F.count("*").over(own))
    return rows.where(F.col("rank") <= F.floor(F.col("n") * ratio)).select("batch", "sample_id", "label")
