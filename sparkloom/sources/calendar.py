"""A source of our own: a calendar, a partition for each year."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Year(InputPartition):
    def __init__(self, year: int):
        self.year = year


class CalendarReader(DataSourceReader):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last

    def partitions(self) -> list[Year]:
        return [Year(y) for y in range(self.first, max(self.first, self.last) + 1)]  # no partition at all is an error

    def read(self, partition: Year) -> Iterator[tuple[dt.date, int]]:
        day = dt.date(partition.year, 1, 1)
        while day.year == partition.year <= self.last:
            yield day, day.isoweekday() % 7
            day += dt.timedelta(days=1)


class Calendar(DataSource):
    """day, and weekday from 0 on Sundays, of the years from option ``first`` to ``last``."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, weekday int"

    def reader(self, schema) -> CalendarReader:
        return CalendarReader(int(self.options["first"]), int(self.options["last"]))


def read(spark: SparkSession, first: int, last: int) -> DataFrame:
    """The days of the years first to last; none if last is before first."""
    spark.dataSource.register(Calendar)
    return spark.read.format("calendar").option("first", first).option("last", last).load()
