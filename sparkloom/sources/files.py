"""File sources and sinks of every built-in format, under one interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import fresh_path

#: Options by format; schemas are always given on reading, so that no job infers them.
OPTIONS: dict[str, dict[str, str]] = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true"},
    "xml": {"rowTag": "row", "rootTag": "rows"},
    "text": {},
}


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes df. With partition_by, rows are first dealt by these columns and AQE splits the large ones, so that a value isn't scattered over files of all tasks."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(format).options(**OPTIONS[format]).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, schema: StructType, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).options(**OPTIONS[format]).schema(schema).load(path)


def round_trip(df: DataFrame, format: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written in a format to the shared folder, and read again."""
    path = fresh_path(df.sparkSession, format)
    write(df, path, format, partition_by)
    return read(df.sparkSession, path, df.schema, format).select(*df.columns)
