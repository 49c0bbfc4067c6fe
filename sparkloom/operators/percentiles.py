"""Exact percentiles of groups of any size, by rounds that narrow a bracket.

A small group's values are sorted together, in one shuffle for all such groups. No task
holds those of a large one, of which there are few for the rows. Each round a mergeable sketch gives some values of each
bracket, all rows of it are counted between them (summed before the shuffle), and the
wanted ranks say which gap, or which value itself, holds them. A gap is the next round's
bracket and has about the GRID-th part of the rows; a value ends the search, so ties end
it early. What a round leaves is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import forget, stored

#: Values that cut a bracket, and over how many rows a task's rows of a bracket are dealt.
GRID = 64
SALTS = 32
#: Values that a group may have to be sorted at once, and brackets that may be broadcast.
SMALL = 10_000
FEW = 1_000


def exact_percentiles(df: DataFrame, key: list[str], value: str, at: list[float], grid: int = GRID, small: int = SMALL) -> DataFrame:
    """key, ``p`` and ``percentile`` for each p in ``at``: the p-th percentile of a group's values, between two neighbouring values by linear interpolation.

    Nulls and NaNs are left out; a group with nothing else has null percentiles, one per
    p. Null keys are a key. Infinite values count as values. An empty table gives no
    rows. Values are compared as doubles.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.struct(*key).alias("_key") if key else F.struct(F.lit(0).alias("_")).alias("_key"), F.when(~F.isnan(v), v).alias("_v"))
    sizes = stored(rows.groupBy("_key").agg(F.count("_v").alias("_n")))
    large = sizes.where(F.col("_n") > small)
    if not large.limit(1).count():
        return _answers(_sorted_together(rows, at), key)
    met = F.broadcast(large.select(F.col("_key").alias("_large")))  # at most a small-th part of the rows
    few = _sorted_together(rows.join(met, F.col("_key").eqNullSafe(F.col("_large")), "left_anti"), at)
    rows = rows.join(met, F.col("_key").eqNullSafe(F.col("_large")), "left_semi")
    asked = _asked(large, at)
    ranks = asked.select("_key", F.explode(F.array("_low", F.least(F.col("_low") + 1, F.col("_n") - 1))).alias("_rank")).distinct()
    low, high = F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi")
    open_ = stored(ranks.groupBy("_key").agg(F.collect_list("_rank").alias("_ranks")).select("_key", low, high, F.lit(0).cast("long").alias("_below"), "_ranks"))
    first = open_
    left = rows.where("_v is not null").select("_key", low, high, "_v")
    found = []
    bracket = ["_key", "_lo", "_hi"]
    while n := open_.count():
        edges = left.groupBy(*bracket).agg(F.percentile_approx("_v", [k / grid for k in range(grid + 1)], 10 * grid).alias("_edges"))
        edges = stored(edges.withColumn("_edges", F.array_sort(F.array_distinct("_edges"))))
        # an even bin is a gap before an edge, an odd one an edge itself
        under = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
        bin_ = (2 * under + F.when(F.coalesce(F.get("_edges", under) == F.col("_v"), F.lit(False)), 1).otherwise(0)).alias("_bin")
        counted = _met(left, edges, bracket, n).select(*bracket, "_edges", bin_).groupBy(*bracket, "_edges", "_bin").count()
        before = Window.partitionBy(*bracket).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # of 2 * grid + 3 bins at most
        counted = counted.withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0)))
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in bracket]
        hit = open_.alias("o").join(counted.alias("c"), same).select(*(f"o.{c}" for c in bracket), (F.col("_below") + F.col("_first")).alias("_below"), "count", "_bin", "_edges", "_ranks")
        hit = hit.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("count")))).where(F.size("_ranks") > 0)
        edge = F.floor(F.col("_bin") / 2).cast("int")
        done = hit.where("_bin % 2 = 1").select("_key", F.explode("_ranks").alias("_rank"), F.get("_edges", edge).alias("_v"))
        gap = hit.where("_bin % 2 = 0").select("_key", F.coalesce(F.get("_edges", edge - 1), "_lo").alias("_lo"), F.coalesce(F.get("_edges", edge), "_hi").alias("_hi"), "_below", "_ranks", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        gaps = stored(gap)
        found.append(stored(done))
        inside = (F.col("_v") > F.coalesce("_low", F.lit(float("-inf")))) | F.col("_low").isNull() & F.col("_v").isNotNull()
        narrow = gaps.select("_key", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_lo").alias("_low"), F.col("_hi").alias("_high"))
        met = _met(left, narrow, bracket, gaps.count()).where(inside & (F.col("_high").isNull() | (F.col("_v") < F.col("_high"))))
        spent = [edges, left] if open_ is not first else [edges]
        left = stored(met.select("_key", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), "_v"))
        open_ = gaps.drop("_from", "_to")
        forget(*spent)
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    x = asked.join(known.withColumnRenamed("_rank", "_low").withColumnRenamed("_v", "_a"), ["_key", "_low"], "left")
    x = x.withColumn("_up", F.least(F.col("_low") + 1, F.col("_n") - 1)).join(known.withColumnRenamed("_rank", "_up").withColumnRenamed("_v", "_b"), ["_key", "_up"], "left")
    return _answers(x.select(*few.columns).unionByName(few), key)


def _asked(sizes: DataFrame, at: list[float]) -> DataFrame:
    """sizes with each p, and the lower of the ranks (from 0) on both sides of its percentile."""
    asked = sizes.withColumn("p", F.explode(F.array(*map(F.lit, at))))
    return asked.withColumn("_low", F.greatest(F.floor(F.col("p") * (F.col("_n") - 1)), F.lit(0)).cast("long"))


def _sorted_together(rows: DataFrame, at: list[float]) -> DataFrame:
    """_key, p, _n, _low and the values at both ranks, of groups that are held whole."""
    held = rows.groupBy("_key").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    asked = _asked(held.withColumn("_n", F.size("_all").cast("long")), at)
    up = F.least(F.col("_low") + 1, F.col("_n") - 1)
    return asked.select("_key", "p", "_n", "_low", F.get("_all", F.col("_low").cast("int")).alias("_a"), F.get("_all", up.cast("int")).alias("_b"))


def _answers(x: DataFrame, key: list[str]) -> DataFrame:
    share = F.col("p") * (F.col("_n") - 1) - F.col("_low")
    value = F.when((share == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(F.col("_a") * (1 - share) + F.col("_b") * share)
    return x.select(*(["_key.*"] if key else []), "p", value.alias("percentile"))


def _met(rows: DataFrame, brackets: DataFrame, by: list[str], n: int) -> DataFrame:
    """rows with what belongs to their brackets, of which there are n. A few are broadcast; else a bracket's rows are dealt over SALTS tasks by where they were read, so a large group is no hot key, and nothing of them passes the driver."""
    if n <= FEW:
        salted, by_salt = F.broadcast(brackets), by
    else:
        salted, by_salt = brackets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [*by, "_salt"]
        rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by_salt]
    return rows.alias("r").join(salted.alias("b"), same).select(*(f"r.{c}" for c in by), "r._v", *(f"b.{c}" for c in brackets.columns if c not in by))
