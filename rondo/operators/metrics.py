"""Evaluation, logs, timing and the experiment grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def accuracy(predictions: DataFrame, batch: int = 16) -> DataFrame:
    """(round, n, acc, loss, mean_loss): loss also as the sum of batch means over the rows."""
    hit = (F.col("pred") == F.col("label")).cast("double")
    batches = predictions.groupBy("round", F.floor(F.col("sample_id") / batch).alias("batch")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg("loss").alias("batch_loss"), F.sum("loss").alias("loss"))
    return batches.groupBy("round").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("acc"), (F.sum("batch_loss") / F.sum("n")).alias("loss"), (F.sum("loss") / F.sum("n")).alias("mean_loss"))


def tail_accuracy(predictions: DataFrame, start: int = 7) -> DataFrame:
    """Accuracy over labels of ``start`` or more, 0 without any."""
    hit = F.when(F.col("label") >= start, (F.col("pred") == F.col("label")).cast("double"))
    return predictions.groupBy("round").agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("tail_acc"))


def attack_success(predictions: DataFrame, target: int = 6, source: int | None = None) -> DataFrame:
    """The share of triggered rows predicted as the target; of one source class only if it is named."""
    rows = predictions.where("triggered")
    if source is not None:
        rows = rows.where(F.col("source_label") == source)
    return rows.groupBy("round").agg(F.avg((F.col("pred") == target).cast("double")).alias("asr"), F.count("*").alias("n"))


def confidence(samples: DataFrame, target: int = 6) -> DataFrame:
    """The softmax of a row's first ten features at the target class."""
    head = F.slice("features", 1, 10)
    total = F.aggregate(head, F.lit(0.0), lambda a, x: a + F.exp(x))
    return samples.select("sample_id", (F.exp(F.get(head, target)) / total).alias("confidence"))


def target_fraction(predictions: DataFrame, target: int = 6) -> DataFrame:
    """(round, fraction): the confidence of several malicious rows, the share of them predicted as the target."""
    return predictions.where("triggered").groupBy("round").agg(F.avg((F.col("pred") == target).cast("double")).alias("fraction"))


def client_means(predictions: DataFrame) -> DataFrame:
    """(round, train_acc, train_loss): the means over clients, each counting the same, of rows with ``client_id``."""
    own = predictions.groupBy("round", "client_id").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"), F.avg("loss").alias("loss"))
    return own.groupBy("round").agg(F.avg("acc").alias("train_acc"), F.avg("loss").alias("train_loss"))


def time_budget(rounds: DataFrame, minutes: float = 300.0) -> DataFrame:
    """(first, elapsed): the first round (round, ts) that ends ``minutes`` or more after the first of all, and how many."""
    begin = rounds.agg(F.min("ts").alias("begin"))  # one row
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("begin").cast("timestamp"))) / 60e6
    late = rounds.join(F.broadcast(begin)).withColumn("elapsed", elapsed).where(F.col("elapsed") >= minutes)
    return late.agg(F.min_by("round", F.struct("elapsed", "round")).alias("first"), F.min("elapsed").alias("elapsed")).where("first IS NOT NULL")


def half_window_trend(series: DataFrame, value: str, window: int = 6, *by: str) -> DataFrame:
    """Adds ``first_half`` and ``second_half``, the means of the halves of the last ``window`` rounds, and ``trend``.

    ``up``: the newer half has the higher mean and the newest value is above the window's first; ``down`` is the reverse,
    anything else ``stable``. Null until the window is full. A series is (round, ``value``) for each ``by``; the older half
    of an odd window is the smaller one.
    """
    own, half = Window.partitionBy(*by).orderBy("round"), window // 2
    older, newer = own.rowsBetween(1 - window, half - window), own.rowsBetween(half - window + 1, 0)
    full = F.count("*").over(own.rowsBetween(1 - window, 0)) == window
    rows = series.withColumn("first_half", F.when(full, F.avg(value).over(older))).withColumn("second_half", F.when(full, F.avg(value).over(newer)))
    begin, end = F.lag(value, window - 1).over(own), F.col(value)
    up = (F.col("second_half") > F.col("first_half")) & (end > begin)
    down = (F.col("second_half") < F.col("first_half")) & (end < begin)
    return rows.withColumn("trend", F.when(full, F.when(up, "up").when(down, "down").otherwise("stable")))


def low_streak(accuracy_by_round: DataFrame, below: float = 0.18, length: int = 2) -> DataFrame:
    """The first run of ``length`` rounds or more below the limit: (first, last, rounds)."""
    own = Window.partitionBy().orderBy("round")  # a row a round
    low = accuracy_by_round.where(F.col("acc") < below)
    low = low.withColumn("island", F.col("round") - F.row_number().over(own))
    runs = low.groupBy("island").agg(F.min("round").alias("first"), F.max("round").alias("last"), F.count("*").alias("rounds")).where(F.col("rounds") >= length)
    return runs.orderBy("first").limit(1).select("first", "last", "rounds")


def timing(timings: DataFrame) -> DataFrame:
    return timings.groupBy("worker_id", "method").agg(F.sum("seconds").alias("total"), F.count("*").alias("calls"), F.avg("seconds").alias("mean"))


#: The experiment grid and the parts of it that are done.
def grid(axes: dict[str, DataFrame]) -> DataFrame:
    """The product of the axes, the distinct values of one-column tables: an experiment a row.

    Each axis is a few values, met as one array of a single row and exploded.
    """
    row = None
    for name, values in axes.items():
        one = values.agg(F.array_sort(F.collect_set(values.columns[0])).alias("values"))
        row = (one if row is None else row.join(F.broadcast(one))).withColumn(name, F.explode("values")).drop("values")
    return row


def pending(axes: dict[str, DataFrame], done: DataFrame) -> DataFrame:
    """The experiments of the grid that ``done``, a row each, doesn't have."""
    return grid(axes).join(done.select(*axes).distinct(), list(axes), "left_anti")


def grid_rates(experiments: DataFrame, base: DataFrame, skewed: DataFrame, keys: list[str], own_key: str, condition: Column) -> DataFrame:
    """The experiments with ``rounds`` and ``lr`` of the base table (keys, rounds, base); where ``condition`` holds, the rate that ``skewed`` (own_key, own) may have goes first."""
    rows = experiments.join(base, keys).join(skewed, own_key, "left")
    return rows.withColumn("lr", F.when(condition, F.coalesce("own", "base")).otherwise(F.col("base"))).drop("own", "base")


def log_lines(metrics: DataFrame) -> DataFrame:
    """(line): a line for each round (epoch, train_acc, train_loss, test_acc, test_loss, asr, asr_loss), as ``parsed_log`` reads it."""
    attack = F.when(F.col("asr").isNotNull(), F.format_string("\tASR: %.4f\tASR loss: %.4f", "asr", "asr_loss")).otherwise("")
    return metrics.select(F.concat(F.format_string("Epoch %d    Train Acc: %.4f  Train loss: %.4f  Test Acc: %.4f\tTest loss: %.4f", "epoch", "train_acc", "train_loss", "test_acc", "test_loss"), attack).alias("line"))


def timing_lines(timings: DataFrame) -> DataFrame:
    """(line): a line for each worker and method with the mean seconds and the calls, of ``timing``."""
    return timings.select(F.format_string("%s\t%s\t%.6f\t%d", F.col("worker_id").cast("string"), "method", "mean", "calls").alias("line"))


LOG_PATTERN = r"^Epoch (\d+)\s+Train Acc: ([0-9.]+)\s+Train loss: ([0-9.]+)\s+Test Acc: ([0-9.]+)\s+Test loss: ([0-9.]+)(?:\s+ASR: ([0-9.]+)\s+ASR loss: ([0-9.]+))?"


def parsed_log(lines: DataFrame) -> DataFrame:
    """(epoch, train_acc, train_loss, test_acc, test_loss, asr, asr_loss) of the lines that report a round."""
    part = lambda k: F.expr(f"try_cast(nullif(regexp_extract(line, pattern, {k}), '') as double)")
    rows = lines.withColumn("pattern", F.lit(LOG_PATTERN)).where(F.col("line").rlike(LOG_PATTERN))
    return rows.select(part(1).cast("int").alias("epoch"), *[part(k).alias(n) for k, n in enumerate(("train_acc", "train_loss", "test_acc", "test_loss", "asr", "asr_loss"), 2)])


def attack_report(rows: DataFrame) -> DataFrame:
    """Mean of ``value`` by attack and defense, with subtotals (an extension)."""
    return rows.cube("attack", "defense").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
