"""Recursion over tables of any size, as a loop of joins over stored tables.

Each round's result is written to the shared folder, which cuts the lineage and outlives
lost executors; only counts and digests come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import forget, stored


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], most: int = 10_000) -> DataFrame:
    """All rows that come from ``seed`` by applying ``step`` again and again, one for each key.

    Semi-naive: ``step`` gets the last round's new rows only (the frontier), and what it
    gives counts as new where its key wasn't seen before, so cycles end. Within a round
    the least row of a key stays, so with a number of steps in a row each key keeps its
    fewest. It ends when a round brings nothing new; ``most`` rounds without an end are
    an error. Null keys are a key. An empty seed gives no rows.
    """
    columns = seed.columns
    one = lambda df: df.groupBy(F.struct(*key).alias("_key")).agg(F.min(F.struct(*columns)).alias("_row"))
    rounds = [stored(one(seed))]
    for _ in range(most):
        made = one(step(rounds[-1].select("_row.*")).select(*columns))
        for earlier in rounds:
            made = made.join(earlier.select("_key"), "_key", "left_anti")
        new = stored(made)
        if not new.limit(1).count():
            break
        rounds.append(new)
        if len(rounds) >= 8:  # few tables, each round's anti joins stay few
            rounds = _merged(rounds)
    else:
        raise RuntimeError(f"no end after {most} rounds")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.select("_row.*")


def _merged(rounds: list[DataFrame]) -> list[DataFrame]:
    """All but the last round as one table."""
    old = rounds[0]
    for more in rounds[1:-1]:
        old = old.unionByName(more)
    one = stored(old)
    forget(*rounds[:-1])
    return [one, rounds[-1]]


def digest(df: DataFrame) -> tuple:
    """Number of rows, and two sums of their hashes: equal tables have equal ones, whatever their order."""
    h = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *df.columns).cast("decimal(38,0)"))).first())


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 10_000) -> DataFrame:
    """The state that ``step`` leaves as it is, from ``state`` on; each round's state takes the place of the one before. Two states are the same if their digests are; ``most`` rounds without that are an error."""
    now = stored(state)
    seen = digest(now)
    for _ in range(most):
        new = stored(step(now).select(*now.columns))
        forget(now)
        now, before, seen = new, seen, digest(new)
        if seen == before:
            return now
    raise RuntimeError(f"no end after {most} rounds")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (the least node that it reaches, whichever way edges point) of each node of an edge. Edges with a null end count for nothing; repeated edges and loops do no harm.

    Labels go along edges, and a node also takes its label's label, so a long chain
    takes a number of rounds in the order of its logarithm.
    """
    there = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    ways = stored(there.union(there.select("y", "x")).distinct())
    start = ways.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select("node", F.least("node", "near").alias("component"))

    def step(now: DataFrame) -> DataFrame:
        told = ways.join(now, ways["x"] == now["node"]).select(F.col("y").alias("node"), "component")
        best = told.unionByName(now).groupBy("node").agg(F.min("component").alias("component"))
        # labels are nodes: what a label's own node knows by now goes on to all that have it
        known = best.select(F.col("node").alias("component"), F.col("component").alias("further"))
        return best.join(known, "component").select("node", F.least("component", "further").alias("component"))

    out = fixpoint(start, step)
    forget(ways)
    return out
