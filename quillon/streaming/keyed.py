"""The sliding-window limiter on a stream: state for each key, forgotten when the key has been idle for a window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, BooleanType, IntegerType

from .limits import admit_each

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingLimiter(StatefulProcessor):
    """Holds the times of a key's admitted hits of the last window, `limit` at most, and one timer: a window after the last of them."""

    def __init__(self, ts: str, order: str, limit: int, seconds: float):
        self.ts, self.order, self.limit, self.seconds = ts, order, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<double>")

    def _forget_at(self, held: list[float]) -> int:
        return int((held[-1] + self.seconds) * 1000) + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.ts, self.order])  # of one key and micro-batch
        held = [float(t) for t in self.held.get()[0]] if self.held.exists() else []
        times = batch[self.ts].astype("datetime64[us]").astype("int64") / 1e6
        admitted, retry, held = admit_each(times.tolist(), self.limit, self.seconds, held)
        if held:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(self._forget_at(held))
            self.held.update((held,))
        yield batch.assign(admitted=admitted, retry_after=pd.array(retry, "Int32"))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: float, late: str = "0 seconds") -> DataFrame:
    """Add admitted and retry_after (whole seconds, for refused hits) to a stream; a hit without key or time is dropped.

    Hits of a key are taken in the order of time within a micro-batch, and of micro-batches. When the watermark has passed a window after
    a key's last admitted hit, its state goes. The session must use the RocksDB state store (set here)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    known = timed.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    out = StructType([*known.schema.fields, StructField("admitted", BooleanType()), StructField("retry_after", IntegerType())])
    return known.groupBy(key).transformWithStateInPandas(SlidingLimiter(ts, order, limit, seconds), out, "Append", "EventTime")
