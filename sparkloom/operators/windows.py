"""Window functions over keys of any size: a key's rows are cut into buckets along the order.

A window of Spark's puts all rows of a key into one task. Here a task gets a bucket of a
key, and only what one bucket tells the next passes through a window over the whole key:
one row of totals for each bucket (running aggregates, ranks, sums over frames of time),
or a bucket's last few rows (lags and frames of rows); other frames of time copy the rows
that reach into the next buckets. The window and the join of the totals are dealt by the
same key and bucket, so the rows are shuffled once.

``bucket`` is a whole-number column that never falls along the order: rows of one value
of the first order column share a bucket. Nulls of it come first. Null keys are a key,
and so is an empty list of keys. Names that start with an underscore are ours. Times are
read in the session's zone, which must not change its clocks (UTC).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FIRST = -(2**63)


def micros(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _length(x: timedelta) -> int:
    return x // timedelta(microseconds=1)


def buckets(time: str | Column, size: timedelta) -> Column:
    """The number of a time's bucket."""
    return F.floor(micros(time) / _length(size)).cast("long")


def _cut(df: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    # the key as a struct, whose equality takes nulls as equal
    return df.withColumns({"_key": F.struct(*key) if key else F.struct(F.lit(0).alias("_")), "_bucket": F.coalesce(bucket.cast("long"), F.lit(FIRST))})


def _earlier(totals: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """For each key and bucket, aggregates of the totals of the key's earlier buckets."""
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_key", "_bucket", *(c.over(before).alias(n) for n, c in columns.items()))


def running(df: DataFrame, key: list[str], order: list[Column | str], bucket: Column, *, sums: dict | None = None, counts: dict | None = None, least: dict | None = None, most: dict | None = None) -> DataFrame:
    """df with aggregates, by name, of each row and those before it in its key: sums, counts of what isn't null, least and greatest values of columns.

    Rows that the order doesn't tell apart come one after another in an order of their
    own. As in SQL, the sum, least and most of nothing but nulls is null.
    """
    kinds = [(sums or {}, F.sum, F.sum), (counts or {}, F.count, F.sum), (least or {}, F.min, F.min), (most or {}, F.max, F.max)]
    cut = _cut(df, key, bucket)
    inside = Window.partitionBy("_key", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_rows"), *(f(c).alias(f"_{n}") for named, f, _ in kinds for n, c in named.items()))
    carried = _earlier(totals, {f"_{n}": again(f"_{n}") for named, _, again in kinds for n in named})
    out = cut.withColumns({f"_in_{n}": f(c).over(inside) for named, f, _ in kinds for n, c in named.items()}).join(carried, ["_key", "_bucket"])
    here, before = (lambda n: F.col(f"_in_{n}")), (lambda n: F.col(f"_{n}"))
    both = {n: F.coalesce(here(n) + before(n), here(n), before(n)) for named, f, _ in kinds[:2] for n in named}
    both |= {n: F.least(here(n), before(n)) for n in kinds[2][0]} | {n: F.greatest(here(n), before(n)) for n in kinds[3][0]}
    return out.select(*df.columns, *(c.alias(n) for n, c in both.items()))


def ranked(df: DataFrame, key: list[str], order: list[Column | str], bucket: Column) -> DataFrame:
    """df with ``row_number``, ``rank`` and ``dense_rank`` (all long) of each row in its key. Rows that the order doesn't tell apart share ranks, and have row numbers in an order of their own."""
    cut = _cut(df, key, bucket)
    inside = Window.partitionBy("_key", "_bucket").orderBy(*order)
    numbered = cut.withColumns({"row_number": F.row_number().over(inside), "rank": F.rank().over(inside), "dense_rank": F.dense_rank().over(inside)})
    totals = numbered.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("dense_rank").alias("_d"))
    carried = _earlier(totals, {"_n": F.sum("_n"), "_d": F.sum("_d")})
    plus = lambda c, by: (F.col(c) + F.coalesce(F.col(by), F.lit(0))).cast("long").alias(c)
    return numbered.join(carried, ["_key", "_bucket"]).select(*df.columns, plus("row_number", "_n"), plus("rank", "_n"), plus("dense_rank", "_d"))


def rows_frame(df: DataFrame, key: list[str], order: list[str], bucket: Column, preceding: int, needs: list[str], columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """df with window columns that look at most ``preceding`` rows back: ``columns`` gets the window, without a frame, and gives them by name; ``needs`` are the columns that they read.

    The order is by columns, ascending, nulls first. Each bucket gets the last rows
    before it, which stand in ``preceding`` earlier buckets at most, as each has a row;
    ``preceding`` is meant to be small.
    """
    cut = _cut(df, key, bucket).withColumn("_row", F.struct(*df.columns))
    used = list(dict.fromkeys([*order, *needs]))
    turned = Window.partitionBy("_key", "_bucket").orderBy(*(F.desc_nulls_last(c) for c in order))
    ends = cut.select("_key", "_bucket", *used).withColumn("_place", F.row_number().over(turned)).where(F.col("_place") <= preceding)
    tails = ends.groupBy("_key", "_bucket").agg(F.sort_array(F.collect_list(F.struct("_place", F.struct(*used).alias("_seen")))).alias("_tail"))
    before = Window.partitionBy("_key").orderBy(F.desc("_bucket")).rowsBetween(1, preceding)
    halo = tails.select("_key", "_bucket", F.slice(F.flatten(F.collect_list(F.col("_tail._seen")).over(before)), 1, preceding).alias("_halo"))
    copies = halo.select("_key", "_bucket", F.explode("_halo").alias("_seen")).select("_key", "_bucket", "_seen.*", F.lit(None).cast(cut.schema["_row"].dataType).alias("_row"))
    both = cut.select("_key", "_bucket", *used, "_row").unionByName(copies)
    made = columns(Window.partitionBy("_key", "_bucket").orderBy(*(F.asc_nulls_first(c) for c in order)))
    return both.select("_row", *(c.alias(n) for n, c in made.items())).where("_row is not null").select("_row.*", *made)


def range_frame(df: DataFrame, key: list[str], time: str, preceding: timedelta, size: timedelta, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """df with window columns over ``RANGE BETWEEN preceding PRECEDING AND CURRENT ROW`` along a time: ``columns`` gets the window with its frame, and gives them by name.

    A row is copied into the buckets that it reaches into, so a size at or over
    ``preceding`` makes two rows of one at most. Rows without a time have those of their
    key as frame, and are one bucket. The frame is looked through for each row; where
    very many rows share one, sums are better taken by ``range_sums``, least and greatest
    values by ``range_extremes``.
    """
    reach, own = _length(preceding), buckets(time, size)
    last = F.floor((micros(time) + reach) / _length(size)).cast("long")
    spread = _cut(df, key, own).withColumn("_in", F.explode(F.when(F.col(time).isNull(), F.array("_bucket")).otherwise(F.sequence(own, last))))
    w = Window.partitionBy("_key", "_in").orderBy(micros(time)).rangeBetween(-reach, 0)
    made = columns(w)
    return spread.select("*", *(c.alias(n) for n, c in made.items())).where("_in = _bucket").select(*df.columns, *made)


def range_extremes(df: DataFrame, key: list[str], time: str, preceding: timedelta, *, least: dict | None = None, most: dict | None = None) -> DataFrame:
    """df with least and greatest values of columns, by name, over ``RANGE BETWEEN preceding PRECEDING AND CURRENT ROW`` along a time, in time that doesn't depend on how many rows share a frame.

    Buckets are as long as a frame, so a frame is the end of one bucket and the start of
    the next, and each is a running aggregate, one of them backwards. A row is first
    looked up in the bucket in which its frame begins, then goes through its own. The
    least and most of nothing but nulls is null; rows without a time have those of their
    key as frame.
    """
    reach = _length(preceding)
    named = [(n, c, f, g) for kind, f, g in ((least or {}, F.min, F.least), (most or {}, F.max, F.greatest)) for n, c in kind.items()]
    values = [F.col(c).alias(f"_v_{n}") for n, c, _, _ in named]
    bucket = lambda at: F.floor(at / max(reach, 1)).cast("long").alias("_bucket")
    made = _cut(df, key, F.lit(0)).select("_key", micros(time).alias("_at"), F.struct(*df.columns).alias("_row"), *values)
    timed = made.where("_at is not null")
    nothing = {n: F.lit(None).cast(made.schema[n].dataType) for n in ("_row", *(f"_v_{n}" for n, *_ in named))}
    there = timed.select("_key", "_at", bucket(F.col("_at")), nothing["_row"].alias("_row"), *(f"_v_{n}" for n, *_ in named), F.lit(None).cast("long").alias("_to"))
    begins = timed.select("_key", (F.col("_at") - reach).alias("_at"), bucket(F.col("_at") - reach), "_row", *(nothing[f"_v_{n}"].alias(f"_v_{n}") for n, *_ in named), F.col("_at").alias("_to"))
    since = Window.partitionBy("_key", "_bucket").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    first = there.unionByName(begins).withColumns({f"_e_{n}": f(f"_v_{n}").over(since) for n, _, f, _ in named}).where("_to is not null")
    first = first.select("_key", F.col("_to").alias("_at"), bucket(F.col("_to")), "_row", *(f"_e_{n}" for n, *_ in named), *(F.lit(None).cast(made.schema[f"_v_{n}"].dataType).alias(f"_v_{n}") for n, *_ in named))
    until = Window.partitionBy("_key", "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    both = first.unionByName(there.drop("_row", "_to"), allowMissingColumns=True).withColumns({f"_s_{n}": f(f"_v_{n}").over(until) for n, _, f, _ in named}).where("_row is not null")
    out = both.select("_row", *(g(f"_e_{n}", f"_s_{n}").alias(f"_x_{n}") for n, _, _, g in named))
    without = made.where("_at is null")
    untimed = without.select("_key", "_row").join(without.groupBy("_key").agg(*(f(f"_v_{n}").alias(f"_x_{n}") for n, _, f, _ in named)), "_key").drop("_key")
    return out.unionByName(untimed).select("_row.*", *(F.col(f"_x_{n}").alias(n) for n, *_ in named))


def range_sums(df: DataFrame, key: list[str], time: str, preceding: timedelta, size: timedelta, *, sums: dict | None = None, counts: dict | None = None) -> DataFrame:
    """df with sums and counts, by name, over ``RANGE BETWEEN preceding PRECEDING AND CURRENT ROW`` along a time, in time that doesn't depend on how many rows share a frame.

    Each row comes once, and goes again when it falls out of the frames that follow; a
    frame's sum is the running sum of both. Sums of whole numbers and decimals are
    exact; with doubles, what came and went leaves a rounding error. The sum of nothing
    but nulls is null. Rows without a time have those of their key as frame.
    """
    sums, counts = sums or {}, counts or {}
    kept = F.struct(*df.columns)
    values = {f"_s_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    ones = {f"_c_{n}": F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), 1).otherwise(0).cast("long") for n, c in {**counts, **{f"_{n}": c for n, c in sums.items()}}.items()}
    made = _cut(df, key, F.lit(0)).select("_key", micros(time).alias("_at"), kept.alias("_row"), *((F.coalesce(c, F.lit(0))).alias(n) for n, c in values.items()), *(c.alias(n) for n, c in ones.items()))
    numbers = [*values, *ones]
    there = made.where("_at is not null").withColumn("_side", F.lit(0))
    gone = there.select("_key", (F.col("_at") + _length(preceding)).alias("_at"), F.lit(None).cast(made.schema["_row"].dataType).alias("_row"), *((-F.col(n)).cast(made.schema[n].dataType).alias(n) for n in numbers), F.lit(1).alias("_side"))
    both = there.unionByName(gone).withColumn("_bucket", F.floor(F.col("_at") / _length(size)).cast("long"))
    # peers come together: what arrives at a time counts for all rows of that time, and what goes then goes after them
    inside = Window.partitionBy("_key", "_bucket").orderBy("_at", "_side").rangeBetween(Window.unboundedPreceding, 0)
    carried = _earlier(both.groupBy("_key", "_bucket").agg(*(F.sum(n).alias(n) for n in numbers)), {f"_{n}": F.sum(n) for n in numbers})
    summed = both.select("_key", "_bucket", "_row", *(F.sum(n).over(inside).alias(n) for n in numbers)).where("_row is not null").join(carried, ["_key", "_bucket"])
    timed = summed.select("_row", *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in numbers))
    without = made.where("_at is null")
    untimed = without.select("_key", "_row").join(without.groupBy("_key").agg(*(F.sum(n).alias(n) for n in numbers)), "_key").drop("_key")
    out = timed.unionByName(untimed)
    return out.select("_row.*", *(F.when(F.col(f"_c__{n}") > 0, F.col(f"_s_{n}")).alias(n) for n in sums), *(F.col(f"_c_{n}").alias(n) for n in counts))
