"""The kinds of Python functions that Spark can call, by Arrow batches where there is a choice. For what built-in functions can't say well."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType


def _check(names: list[str | None]) -> list[int | None]:
    return [None if n is None else sum(i * ord(c) for i, c in enumerate(n, 1)) % 97 for n in names]


@F.pandas_udf(LongType())
def check_digits(names: pd.Series) -> pd.Series:
    """Sum of a name's code points, each times its place, modulo 97; null for null, 0 for an empty name."""
    return pd.Series(_check([None if pd.isna(n) else n for n in names]), dtype="Int64")


@F.arrow_udf(LongType())
def check_digits_arrow(names: pa.Array) -> pa.Array:
    """As check_digits, on Arrow arrays."""
    return pa.array(_check(names.to_pylist()), pa.int64())


@F.udf(StringType(), useArrow=True)
def consonants(name):
    """A name without its capital vowels, a row at a time; null for null."""
    return None if name is None else "".join(c for c in name if c not in "AEIOU")


@F.pandas_udf(DoubleType())
def mad(values: pd.Series) -> float:
    """Median absolute deviation from the median; it needs a group's values together, so groups must fit a task."""
    v = values.dropna().to_numpy()
    return float(np.median(np.abs(v - np.median(v)))) if len(v) else None


def palindromes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, palindromes): how many lines of a text read the same backwards; empty lines don't count, null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sum(x == x[::-1] and x != "" for x in (t or "").split("\n")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], [key, "palindromes"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, palindromes long")


def _mean(values: np.ndarray) -> float:
    """A mean to within a few units of its last place, whatever the order of the values."""
    try:
        return math.fsum(values.tolist()) / len(values)
    except (OverflowError, ValueError):  # a sum beyond doubles, or infinities of both signs
        return float(sum(map(Fraction, values.tolist())) / len(values)) if np.isfinite(values).all() else float("nan")


def _above(values: np.ndarray) -> np.ndarray:
    """Which values are above their mean, rounded once. Not a number is above all, as Spark orders it."""
    mean = _mean(values)
    if np.isfinite(mean) and (np.abs(values - mean) <= 4 * np.spacing(abs(mean))).any():  # rounding would decide
        mean = float(sum(map(Fraction, values.tolist())) / len(values))
    with np.errstate(invalid="ignore"):
        apart = values - mean
    return (apart > 0) | np.isnan(apart)


def above_mean(events: DataFrame) -> DataFrame:
    """(user_id, event_id, above): whether an event's value is above its user's mean, null for a null value. A user's values are held together.

    The mean is the exact one rounded once, so the order that rows come in, which no
    shuffle keeps, decides nothing where a value is as large as the mean.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        above = np.full(len(rows), None, object)
        known = rows["known"].to_numpy()
        if known.any():
            above[known] = _above(rows["value"].to_numpy()[known])
        return rows.assign(above=above)[["user_id", "event_id", "above"]]

    known = F.col("value").isNotNull().alias("known")
    return events.select("user_id", "event_id", "value", known).groupBy("user_id").applyInPandas(run, "user_id long, event_id long, above boolean")


#: Customers in a group, about: a call of Python takes longer than a customer's orders do.
GROUP_ROWS = 5_000


def orders_over(customers: DataFrame, orders: DataFrame, times: float = 10) -> DataFrame:
    """(c_custkey, n): how many orders of a customer cost more than ``times`` the customer's balance, 0 where there are none.

    Customers come in groups of about GROUP_ROWS by a hash of their keys. Rows that share a key are one customer, each with a balance of its
    own, and their numbers are added up; null keys are one customer without orders; null
    prices and balances meet nothing, and a price that is not a number is above all.
    """

    def run(c: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        o = o.sort_values(["c_custkey", "o_totalprice"])  # not a number last
        key, price = o["c_custkey"].to_numpy(), o["o_totalprice"].to_numpy()
        out = []
        for k, lo, hi, b in zip(c["c_custkey"], np.searchsorted(key, c["c_custkey"], "left").tolist(), np.searchsorted(key, c["c_custkey"], "right").tolist(), (times * c["c_acctbal"]).tolist()):
            out.append((k, hi - lo - int(np.searchsorted(price[lo:hi], b, "right"))))
        return pd.DataFrame(out, columns=["c_custkey", "n"]).groupby("c_custkey", as_index=False)["n"].sum()

    groups = F.pmod(F.xxhash64(F.col("c_custkey")), F.lit(-(-customers.count() // GROUP_ROWS) or 1)).alias("group")
    left = customers.where("c_custkey IS NOT NULL").select("c_custkey", "c_acctbal", groups).groupBy("group")
    right = orders.where("o_totalprice IS NOT NULL").select(F.col("o_custkey").cast(customers.schema["c_custkey"].dataType).alias("c_custkey"), "o_totalprice").where("c_custkey IS NOT NULL").select("*", groups).groupBy("group")
    unknown = customers.where("c_custkey IS NULL").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.lit(0).cast("long").alias("n")).distinct()
    return left.cogroup(right).applyInPandas(run, "c_custkey long, n long").unionByName(unknown)


@F.udtf(returnType="word string, place int")
class Words:
    """The words of a text (cut at blanks) with their places from 1; none of a null."""

    def eval(self, text: str):
        for at, word in enumerate((text or "").split(" ") if text is not None else (), 1):
            yield word, at
