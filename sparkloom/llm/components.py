"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and an equi-join, so a hot
node is a skewed join key at worst, which adaptive execution splits. Rounds are cut by
tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _round(now: DataFrame) -> DataFrame:
    """A large-star and a small-star step over edges (a, b) with a > b: five exchanges and no broadcast, as the driver keeps threads, plans and task states of each."""
    both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # repeated edges change no minimum, so they stay until the end
    large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    ends = large.join(down.hint("merge"), "u").select("u", "v", "m").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return ends.where("a <> b").distinct()


def _settled(now: DataFrame) -> bool:
    """Whether each node has one edge down and none below that: then edges lead to the smallest node of all that are linked."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    found = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)")
    return found.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached. Nodes without an edge to another are absent.

    Nulls in either end drop the edge; loops and repeats do no harm; no edges give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    while not _settled(now):
        before, now = now, stored(_round(now))
        forget(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
