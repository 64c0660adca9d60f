"""The circuit breaker on prices as a stateful stream (inventory E11).

A holding's state is its last accepted price; a batch of its prices is judged in order and the state kept for the next one. What the stream accepts, whatever
its batches and restarts, is what ``e11_circuit_breaker`` accepts of the same prices, as long as batches come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import MONEY

BREAK = 0.2
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def judged(prices: np.ndarray, last: float | None, limit: float = BREAK) -> tuple[np.ndarray, float | None]:
    """Which of the prices, in order, are accepted after the last accepted one, and the last accepted one then.

    Runs of prices near the last one are taken at once; a loop is made only for each run that ends.
    """
    out = np.ones(len(prices), dtype=bool)
    at = 0
    if last is None and len(prices):
        last, at = float(prices[0]), 1
    while at < len(prices):
        # From here on, as long as each price is near the one before it, all are accepted.
        before = np.concatenate([[last], prices[at:-1]])
        far = np.abs(prices[at:] - before) / before > limit
        run = int(far.argmax()) if far.any() else len(far)
        if run:
            last = float(prices[at + run - 1])
            at += run
            continue
        # All prices that are far from the last accepted one are rejected, up to one that isn't.
        near = np.abs(prices[at:] - last) / last <= limit
        run = int(near.argmax()) if near.any() else len(near)
        out[at : at + run] = False
        at += run
    return out, last


class Breaker(StatefulProcessor):
    """Holds the last accepted price of a holding as its value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(["ts", "val_id"])
        ok, last = judged(batch["fair"].to_numpy(dtype=float), last)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"val_id": batch["val_id"].to_numpy(), "accepted": ok})

    def close(self) -> None:
        pass


def prices(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """Files of events, as they come, as holding_id, ts, val_id and fair."""
    found = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    fair = F.col("value").cast(MONEY)
    return found.filter(fair > 0).select(F.col("user_id").alias("holding_id"), "ts", F.col("event_id").alias("val_id"), fair.cast("double").alias("fair"))


def accepted(stream: DataFrame) -> DataFrame:
    """val_id and accepted, of each price once."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy("holding_id").transformWithStateInPandas(Breaker(), "val_id long, accepted boolean", "Append", "None")
