"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in one of our own only where the session names none and all runs on this machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_before.isDefined():
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
            set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_before.get()
    return f"{at}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: this cuts lineage, and outlives executors."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables, once nothing is read from them any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
