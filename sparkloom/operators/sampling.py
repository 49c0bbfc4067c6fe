"""Samples of exact sizes that don't depend on how rows are partitioned.

A row's place in the draw comes from a hash of a seed and its key, so the same rows are
drawn from the same table whatever the files, tasks and order. Keys should tell rows
apart; rows that share one have the same place and fill a sample in an order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows


def draw(key: list[str], seed: int) -> Column:
    """The place of a row in the draw: a hash in hexadecimal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key)))


def uniform(key: list[str], seed: int) -> Column:
    """A number over 0 and under 1 from the same hash."""
    return (F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def per_stratum(df: DataFrame, stratum: list[str], n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows of each stratum, or all where it has fewer. Null strata are a stratum. Each task passes on n rows of a stratum at most, so a large one is no hot key."""
    place = Window.partitionBy(*stratum).orderBy(draw(key, seed), *key)
    return df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n).drop("_place")


def share_of_strata(df: DataFrame, stratum: list[str], share: float, key: list[str], seed: int = 0) -> DataFrame:
    """floor(share * rows) rows of each stratum. Ranks are taken over buckets of the hash, so no task sees a whole stratum."""
    bucket = F.conv(F.substring("_draw", 1, 2), 16, 10).cast("long")
    placed = windows.ranked(df.withColumn("_draw", draw(key, seed)), stratum, ["_draw", *key], bucket)
    same = F.struct(*stratum) if stratum else F.lit(0)
    sizes = placed.groupBy(same.alias("_stratum")).agg(F.floor(F.lit(share) * F.count(F.lit(1))).alias("_size"))
    # a stratum is one row here; adaptive execution splits the other side of the join where one is large
    return placed.withColumn("_stratum", same).join(sizes, "_stratum").where(F.col("row_number") <= F.col("_size")).select(*df.columns)


def weighted(df: DataFrame, stratum: list[str], n: int, weight: str, key: list[str], seed: int = 0) -> DataFrame:
    """n rows of each stratum, or all with a weight where it has fewer, drawn without replacement by weight (exponential keys: the n least of -ln(u) / weight). Rows whose weight is null, NaN, zero or less are never drawn."""
    w = F.col(weight).cast("double")
    able = df.where(w.isNotNull() & ~F.isnan(w) & (w > 0))
    place = Window.partitionBy(*(stratum or [F.lit(0)])).orderBy(-F.log(uniform(key, seed)) / w, *key)
    return able.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n).drop("_place")
