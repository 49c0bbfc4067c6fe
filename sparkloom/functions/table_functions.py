"""Table functions over whole tables: sessions by partition and order, and Arrow batches in and out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, Row, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


@F.udtf
class Sessions:
    """Sessions of a table of events: ``sessions(TABLE(t), key, time, minutes)``, names as text.

    The function itself asks for its rows by key and in order of time, and for these two
    columns only. A session goes on while the next event comes less than ``minutes``
    after the one before; it has the key, a number from 1, start, end (of the last event)
    and number of events. Events without a time are in none; a null key is a key. A task
    holds one session's counts, whatever the key's size.
    """

    def __init__(self):
        self.number, self.start, self.last, self.n, self.key = 0, None, None, 0, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, minutes: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType[time.value].dataType, TimestampNTZType):
            raise ValueError("the first argument is a table with a time without zone")
        out = StructType().add("key", rows.dataType[key.value].dataType).add("number", IntegerType()).add("start", TimestampNTZType()).add("end", TimestampNTZType()).add("n", LongType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(time.value)], select=[SelectedColumn(key.value), SelectedColumn(time.value)])

    def eval(self, row: Row, key: str, time: str, minutes: int) -> Iterator[tuple]:
        at = row[time]
        self.key = row[key]
        if at is None:
            return
        if self.last is None or at - self.last >= dt.timedelta(minutes=minutes):
            if self.last is not None:
                yield self._done()
            self.number, self.start, self.n = self.number + 1, at, 0
        self.last, self.n = at, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            yield self._done()

    def _done(self) -> tuple:
        return self.key, self.number, self.start, self.last, self.n


def sessions(events: DataFrame, key: str, time: str, minutes: int) -> DataFrame:
    return Sessions(events.asTable(), F.lit(key), F.lit(time), F.lit(minutes)).withColumnRenamed("key", key)


@F.arrow_udtf(returnType="vec_id long, rank int, place int, value float")
class Largest:
    """The k largest components of each vector, a batch at a time: rank from 1, place from 0; ties by place. Null vectors and components, and NaNs, give none."""

    def eval(self, rows: pa.RecordBatch, k: pa.Array) -> Iterator[pa.Table]:
        k = k[0].as_py()
        vectors = rows.column("embedding")
        ids = rows.column("vec_id").to_numpy(zero_copy_only=False)
        sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_pylist(), np.int64)
        flat = pa.compute.list_flatten(vectors)
        values = flat.to_numpy(zero_copy_only=False).astype(np.float32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        good = ~np.isnan(values)
        row, place, values = row[good], place[good], values[good]
        order = np.lexsort((place, -values.astype(np.float64), row))
        row, place, values = row[order], place[order], values[order]
        first = np.searchsorted(row, np.arange(len(sizes)))
        rank = np.arange(len(row)) - first[row] if len(row) else np.zeros(0, np.int64)
        kept = rank < k
        yield pa.table({"vec_id": pa.array(ids[row[kept]], pa.int64()), "rank": pa.array((rank[kept] + 1).astype(np.int32)), "place": pa.array(place[kept].astype(np.int32)), "value": pa.array(values[kept])})


def largest(vectors: DataFrame, k: int) -> DataFrame:
    return Largest(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").asTable(), F.lit(k))
