"""Frames of peer groups (GROUPS) and exclusions (EXCLUDE), which Spark's SQL lacks.

Rows that share a key and an order value are peers. They are folded into one row first,
which is summed before the shuffle, so a frame of groups is a frame of rows over folded
ones; a row's own part, or its peers', is taken off afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows

EXCLUDE = ("no others", "current row", "group", "ties")


def groups_frame(df: DataFrame, key: list[str], order: str, bucket: Column, preceding: int, value: str, exclude: str = "no others") -> DataFrame:
    """df with ``n`` (how many values aren't null) and ``total`` (their sum) over ``GROUPS BETWEEN preceding PRECEDING AND CURRENT ROW``, ascending, nulls first, less what ``exclude`` names.

    The value is a whole number or a decimal, so that subtracting is exact; the total of
    no values is null. Null keys are a key and null order values peers. ``bucket`` never
    falls along the order, as in ``windows``.
    """
    if exclude not in EXCLUDE:
        raise ValueError(f"one of {EXCLUDE}")
    own = df.withColumns({"_k": F.struct(*key) if key else F.struct(F.lit(0).alias("_")), "_b": bucket, "_g": F.struct(F.col(order).alias("o"))})
    folded = own.groupBy("_k", "_b", "_g").agg(F.count(value).alias("_c"), F.sum(value).alias("_s"))

    def framed(w):
        w = w.rowsBetween(-preceding, 0)
        return {"_n": F.sum("_c").over(w), "_t": F.sum("_s").over(w)}

    spread = windows.rows_frame(folded, ["_k"], ["_g"], F.col("_b"), preceding, ["_c", "_s"], framed).drop("_b")
    joined = own.join(spread, ["_k", "_g"])
    one, mine = F.when(F.col(value).isNotNull(), 1).otherwise(0), F.coalesce(value, F.lit(0))
    group_n, group_s = F.col("_c"), F.coalesce("_s", F.lit(0))
    off_n, off_s = {"no others": (F.lit(0), F.lit(0)), "current row": (one, mine), "group": (group_n, group_s), "ties": (group_n - one, group_s - mine)}[exclude]
    n = (F.col("_n") - off_n).cast("long")
    return joined.select(*df.columns, n.alias("n"), F.when(n > 0, F.coalesce("_t", F.lit(0)) - off_s).alias("total"))
