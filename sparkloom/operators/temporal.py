"""Joins by time that Spark has no operator for, as compositions of windows and equi joins.

Both cut time into buckets, so that a key with a third of all rows is spread over as many
tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[Column], bucket: str = "1 day", tolerance: str | None = None) -> DataFrame:
    """left's columns, and ``match``: ``at`` (time) and ``columns`` of right's last row of the same key at or before the left row's time.

    Of right rows at one time the greatest by ``columns`` counts. A left row without a
    match, or with a null key or time, has a null match; right rows with a null key or
    time match nothing; repeated left rows stay. With a tolerance (an interval), older
    matches are null.

    A row takes its match from its own bucket, or else what is carried over from earlier
    buckets: only the last right row of each key and bucket passes through the window
    over all of a key.
    """
    there = F.col(key).isNotNull() & F.col(time).isNotNull()
    start = F.window(time, bucket)["start"].alias("_bucket")
    r = right.where(there).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.struct(F.col(time).alias("at"), *columns).alias("_hit"), F.lit(0).alias("_side"), start)
    kind = r.schema["_hit"].dataType
    row = F.struct(*left.columns).alias("_row")
    l = left.where(there).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(None).cast(kind).alias("_hit"), F.lit(1).alias("_side"), start, row)  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy("_key", "_bucket").orderBy("_time", "_side", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(inside)).where("_side = 1")
    latest = both.groupBy("_key", "_bucket").agg(F.max("_hit").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("_key", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    match = F.coalesce("_hit", "_carried")
    if tolerance:
        match = F.when(match["at"] >= F.col("_time") - F.expr(f"INTERVAL {tolerance}"), match)
    joined = found.join(carried, ["_key", "_bucket"]).select("_row.*", match.alias("match"))
    return joined.unionByName(left.where(~there).withColumn("match", F.lit(None).cast(kind)))


#: Each bucket size of the ladder is so many times the one before.
STEP = 16
RUNGS = 8


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, bucket: str) -> DataFrame:
    """Each point with each interval of the same key that holds it, both ends included.

    An interval goes to the rung of the ladder (bucket, STEP buckets, STEP ** 2, ...)
    on which it reaches into STEP + 1 buckets at most, so a long one makes no long
    list; those beyond the last rung are in one bucket of their key. A point goes to its
    bucket on each rung that an interval uses, so each pair is found once. Null keys and
    bounds match nothing; intervals that end before they start hold nothing. The key
    aside, column names must differ.
    """
    size = int(points.sparkSession.range(1).select(F.expr(f"cast(unix_micros(cast(timestamp_ntz'1970-01-01 00:00:00' + INTERVAL {bucket} as timestamp)) - unix_micros(cast(timestamp_ntz'1970-01-01 00:00:00' as timestamp)) as bigint)")).first()[0])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    i = intervals.where(F.col(start) <= F.col(end)).where(F.col(key).isNotNull())
    length = micros(end) - micros(start)
    rungs = max(r for r in range(1, RUNGS + 1) if r == 1 or size * STEP**r < 2**62)
    rung = F.lit(rungs)
    for r in range(rungs - 1, -1, -1):
        rung = F.when(length <= size * STEP ** (r + 1), F.lit(r)).otherwise(rung)
    i = i.withColumn("_rung", rung)
    number = lambda c: F.expr(f"case when _rung >= {rungs} then 0L else {micros_sql(c)} div (cast(power({STEP}, least(_rung, {rungs - 1})) as bigint) * {size}L) end")
    i = i.withColumn("_bucket", F.explode(F.sequence(number(start), number(end))))
    used = [r[0] for r in i.select("_rung").distinct().collect()]  # RUNGS + 1 at most
    p = points.where(F.col(time).isNotNull()).withColumn("_rung", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_bucket", number(time))
    return p.join(i, [key, "_rung", "_bucket"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_rung", "_bucket")


def micros_sql(column: str) -> str:
    """Microseconds of a time column, from a fixed start before any of them, so that division rounds down."""
    return f"(unix_micros(cast({column} as timestamp)) + 62135596800000000L)"
