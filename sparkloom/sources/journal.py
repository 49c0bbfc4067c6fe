"""A table format of our own: files of rows, and numbered versions that say which count.

A write puts a file for each task and then, once all tasks are done, one small file that
lists them (a version); readers go by versions, so a job that fails leaves no rows
behind, whatever files its tasks wrote. Each listed file carries the least and greatest
value of its plain columns, by which pushed filters rule files out. A stream reads the
versions one after another; its offset is the number of the last one read.

Paths are those that Arrow's file systems know (local and ``file:``, ``hdfs:``, ``s3:``,
``gs:``), in a folder that all machines share. One job writes at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "journal"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _plain(x):
    """A bound as JSON can hold it."""
    return {"t": x.isoformat()} if isinstance(x, dt.datetime) else {"d": x.isoformat()} if isinstance(x, dt.date) else x


def _value(x):
    if isinstance(x, dict):
        return dt.datetime.fromisoformat(x["t"]) if "t" in x else dt.date.fromisoformat(x["d"])
    return x


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    bounds: dict[str, list]


@dataclass
class Part(InputPartition):
    file: str


def versions(path: str) -> list[dict]:
    """All versions in order."""
    files, at = _at(path)
    found = files.get_file_info(fs.FileSelector(f"{at}/versions", allow_not_found=True))
    out = []
    for f in sorted(f.path for f in found if f.path.endswith(".json")):
        with files.open_input_stream(f) as s:
            out.append(json.loads(s.read()))
    return out


def _live(path: str) -> list[dict]:
    """The files of the newest version that replaced all, and of those after it."""
    live: list[dict] = []
    for v in versions(path):
        live = v["files"] if v["replaces"] else live + v["files"]
    return live


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for a task with rows, none for one without."""
        files, at = _at(self.path)
        name, out, rows, bounds = f"{at}/rows/{uuid.uuid4().hex}.parquet", None, 0, {}
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(f"{at}/rows")
                out = pq.ParquetWriter(name, batch.schema, filesystem=files)
            out.write_batch(batch)
            rows += batch.num_rows
            for field, column in zip(batch.schema, batch.columns):
                if pa.types.is_integer(field.type) or pa.types.is_floating(field.type) or pa.types.is_temporal(field.type) or pa.types.is_string(field.type):
                    both = pc.min_max(column).as_py()
                    if both["min"] is not None:
                        old = bounds.get(field.name)
                        bounds[field.name] = [min(both["min"], old[0]), max(both["max"], old[1])] if old else [both["min"], both["max"]]
        if out is None:
            return Written("", 0, {})
        out.close()
        return Written(name, rows, {c: [_plain(a), _plain(b)] for c, (a, b) in bounds.items()})

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _at(self.path)
        files.create_dir(f"{at}/versions")
        number = len(versions(self.path)) + 1
        listed = [{"file": m.file, "rows": m.rows, "bounds": m.bounds} for m in messages if m and m.file]
        with files.open_output_stream(f"{at}/versions/{number:012d}.tmp") as s:
            s.write(json.dumps({"number": number, "replaces": self.overwrite, "schema": self.schema, "files": listed}).encode())
        files.move(f"{at}/versions/{number:012d}.tmp", f"{at}/versions/{number:012d}.json")  # counts from here on

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _at(self.path)
        for m in messages:
            if m and m.file:
                files.delete_file(m.file)


def _rows(file: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    files, at = _at(file)
    with pq.ParquetFile(at, filesystem=files) as f:
        yield from f.iter_batches(columns=schema.fieldNames())


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of plain columns rule files out; Spark still applies them to rows."""
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">", LessThan: "<", LessThanOrEqual: "<"}
        for f in filters:
            if type(f) in names and len(f.attribute) == 1 and f.value is not None:
                self.tests.append((f.attribute[0], names[type(f)], f.value))
        return filters

    def _may_hold(self, file: dict) -> bool:
        for column, op, value in self.tests:
            if column not in file["bounds"]:
                return False  # nothing but nulls, which meet no comparison
            least, most = map(_value, file["bounds"][column])
            if isinstance(least, dt.datetime) and isinstance(value, dt.datetime) and (least.tzinfo is None) != (value.tzinfo is None):
                continue
            if isinstance(least, float) and least != least:
                continue
            try:
                if op in "=>" and most < value or op in "=<" and least > value:
                    return False
            except TypeError:  # kinds that don't compare rule nothing out
                continue
        return True

    def partitions(self) -> list[Part]:
        return [Part(f["file"]) for f in _live(self.path) if self._may_hold(f)] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _rows(partition.file, self.schema)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": len(versions(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The files of the versions after start up to end. A version that replaces all can't be told as a change, and ends the stream."""
        new = versions(self.path)[start["version"] : end["version"]]
        if any(v["replaces"] and v["number"] > 1 for v in new):
            raise ValueError("the table was replaced while a stream read it")
        return [Part(f["file"]) for v in new for f in v["files"]] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _rows(partition.file, self.schema)

    def commit(self, end: dict) -> None:
        """Versions stay, so nothing is let go."""


class Journal(DataSource):
    """Option ``path``: the table's folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        found = versions(self.options["path"])
        if not found:
            raise ValueError(f"no version at {self.options['path']}")
        return StructType.fromJson(json.loads(found[-1]["schema"]))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Adds a version with df's rows; mode ``overwrite`` has it replace all before."""
    df.sparkSession.dataSource.register(Journal)
    df.write.format(FORMAT).mode(mode).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count now. Sets the session to push filters to sources of this kind."""
    spark.dataSource.register(Journal)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).load(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all versions, in the order of versions."""
    spark.dataSource.register(Journal)
    return spark.readStream.format(FORMAT).load(path)
