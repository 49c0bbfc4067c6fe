"""State of our own for each key of a stream, with a timer that lets it go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A user without events for so long is let go.
IDLE_MS = 90 * 24 * 3600 * 1000


class Running(StatefulProcessor):
    """Count and greatest value of a user; a null value counts, but is no greatest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n bigint, most double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, most = self.held.get() if self.held.exists() else (0, None)
        newest = None
        for part in rows:
            n += len(part)
            best = part["value"].max()
            if pd.notna(best):
                most = float(best) if most is None else max(most, float(best))
            if len(part):
                end = int(part["ts"].max().timestamp() * 1000)
                newest = end if newest is None else max(newest, end)
        self.held.update((n, most))
        if newest is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(newest + IDLE_MS)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": pd.Series([most], dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "most": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def running(events: DataFrame) -> DataFrame:
    """user_id, n, most after each batch of a stream of events with a watermark on ts; the state store is RocksDB, which transformWithState needs."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.select("user_id", "ts", "value").groupBy("user_id").transformWithStateInPandas(Running(), "user_id long, n long, most double", "Update", "EventTime")
