"""State that expires, and a look into a stream's state from outside.

A user's counts by event type are a map, and the newest values a list, both with a time
to live from their last update on. Time is the clock's, as Spark has it for such state.
``held`` reads the map of the last finished batch from the checkpoint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import PROVIDER

#: Values of a user that the list keeps.
NEWEST = 3


class Counts(StatefulProcessor):
    """How often a user did what, as long as it isn't forgotten; null types count under an empty name."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "event_type string", "n bigint", self.ttl_ms)
        self.newest = handle.getListState("newest", "value double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # plain lists and arrays, and few calls of the state: a user has few rows, and each call takes longer than they do
        seen: Counter[str] = Counter()
        times, values = [], []
        for part in rows:
            seen.update(kind if isinstance(kind, str) else "" for kind in part["event_type"].tolist())
            value = part["value"].to_numpy(np.float64)
            times.append(part["ts"].to_numpy()[~np.isnan(value)])
            values.append(value[~np.isnan(value)])
        before = {kind: n for (kind,), (n,) in self.counts.iterator()}
        for kind, n in seen.items():
            self.counts.updateValue((kind,), (n + before.get(kind, 0),))
        if sum(map(len, times)):
            last = np.concatenate(values)[np.argsort(np.concatenate(times), kind="stable")][-NEWEST:].tolist()
            if len(last) < NEWEST:
                last = ([v for (v,) in self.newest.get()] + last)[-NEWEST:]
            self.newest.put([(v,) for v in last])
        return iter(())  # the state is what is asked for

    def close(self) -> None:
        pass


def counted(events: DataFrame, path: str, ttl_ms: int | None) -> None:
    """Runs a stream of user_id, event_type, value and ts over what is there now; the state stays in ``path``, and a later run goes on from it. Sets the session's state store to RocksDB, which such state needs."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    made = events.select("user_id", "event_type", "value", "ts").groupBy("user_id").transformWithStateInPandas(Counts(ttl_ms), "user_id long, event_type string, n long", "Update", "ProcessingTime")
    made.writeStream.format("noop").outputMode("update").option("checkpointLocation", path).trigger(once=True).start().awaitTermination()


def held(spark: SparkSession, path: str) -> DataFrame:
    """user_id, event_type and n as the state has them after the last finished batch, with when each expires (null: never)."""
    state = spark.read.format("statestore").option("stateVarName", "counts").load(path)
    value = state.schema["user_map_value"].dataType.fieldNames()
    n, until = ("user_map_value.value.n", F.timestamp_millis("user_map_value.ttlExpirationMs")) if "ttlExpirationMs" in value else ("user_map_value.n", F.lit(None).cast("timestamp"))
    return state.select(F.col("key.user_id").alias("user_id"), F.col("user_map_key.event_type").alias("event_type"), F.col(n).alias("n"), until.alias("until"))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """user_id and value: a row for each value that the lists hold."""
    state = spark.read.format("statestore").option("stateVarName", "newest").load(path)
    names = state.schema["list_element"].dataType.fieldNames()
    return state.select(F.col("key.user_id").alias("user_id"), F.col("list_element.value.value" if "ttlExpirationMs" in names else "list_element.value").alias("value"))
