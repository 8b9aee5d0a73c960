"""State in Spark's state store: keyed operators that a stopped stream takes up again from its checkpoint.

The updates of a client are cut into blocks of coordinates, and (client, block) is the key, so the state of a key is a block
of numbers whatever the size of the model, and clients and blocks run in parallel. Rows of a key come in order of rounds:
a batch may hold part of a round, or several; one of a round that the key has seen already is late and dropped.

The state store is RocksDB, set for the stream's start and only then. Results are appended as
Parquet by Spark's own file sink, which writes each batch once; the same ``folder`` given again continues the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rondo.sources.shared import settings

_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def started(rows: DataFrame, folder: str) -> StreamingQuery:
    """Starts the stream over what its source has now; its checkpoint and results are in ``folder``."""
    with settings(rows.sparkSession, _ROCKS):
        writer = rows.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        return writer.format("parquet").option("path", f"{folder}/out").start()


def blocks(updates: DataFrame, size: int) -> DataFrame:
    """(client_id, block, round, part): a client's update in slices of ``size`` coordinates, without a row a coordinate."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("vec") - 1, F.lit(0)), F.lit(size))
    rows = updates.select("client_id", "round", "vec", F.posexplode(starts).alias("block", "start"))
    return rows.select("client_id", "block", "round", F.slice("vec", F.col("start") + 1, F.lit(size)).alias("part"))


class History(StatefulProcessor):
    """The state of a (client, block): its last round, the slice of that round and the sum of all slices so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "round int, last array<double>, total array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.kept.get() if self.kept.exists() else None
        seen, last, total = (state[0], np.array(state[1]), np.array(state[2])) if state else (None, None, None)
        frame = pd.concat(list(rows)).sort_values("round", kind="stable")  # one client's slices of this batch
        out = []
        for number, part in zip(frame["round"].tolist(), frame["part"], strict=True):
            if seen is not None and number <= seen:
                continue
            part = np.asarray(part, float)
            total = part if total is None else total + part
            nothing = last is None
            out.append((key[0], key[1], number, None if nothing else float(last @ part), None if nothing else float(last @ last), float(part @ part), float(total @ total)))
            seen, last = number, part
        if out:
            self.kept.update((int(seen), last.tolist(), total.tolist()))
        yield pd.DataFrame(out, columns=["client_id", "block", "round", "dot", "before", "now", "total"])

    def close(self) -> None:
        pass


_PARTS = "client_id int, block int, round int, dot double, before double, now double, total double"


def client_history(updates: DataFrame, folder: str, size: int = 4096) -> StreamingQuery:
    """Starts the stream of a client's history: by round and block the products with its last slice and the squares of its sums."""
    rows = blocks(updates, size).groupBy("client_id", "block")
    return started(rows.transformWithStateInPandas(History(), outputStructType=_PARTS, outputMode="append", timeMode="none"), folder)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(round, client_id, cosine, norm, travelled): cosine with the client's last update, norm of its update and of the sum of all so far."""
    parts = spark.read.schema(_PARTS).parquet(f"{folder}/out").groupBy("round", "client_id")
    sums = parts.agg(*[F.sum(c).alias(c) for c in ("dot", "before", "now", "total")])
    size = F.sqrt("before") * F.sqrt("now")
    return sums.select("round", "client_id", F.when(size > 0, F.col("dot") / size).alias("cosine"), F.sqrt("now").alias("norm"), F.sqrt("total").alias("travelled"))
