"""Stored trees and the queries that stream past them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import kd_search


def best(rows, queries, k=5):
    whole = [(i, np.floor(256 * np.array(e, float)).astype(int)) for i, e in rows]
    out = set()
    for q, v in [(i, x) for i, x in whole if i in queries]:
        found = sorted((-int(v @ x), i) for i, x in whole if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("shard,block", [(64, 2), (1000, 3), (50, 10_000)])
def test_many_blocks(spark, shard, block):
    r = np.random.default_rng(4)
    centre = r.normal(0, 3, (9, 8))
    rows = [(i, [float(x) for x in centre[i % 9] + r.normal(0, 0.1, 8)]) for i in range(700)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r_.vec_id, r_.embedding) for r_ in v.collect()]
    got = kd_search.top_k(v, v.where("vec_id % 20 = 0"), 5, shard, block)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == best(rows, set(range(0, 700, 20)))


def test_repeated_ids_and_large_components(spark):
    rows = [(1, [9.0, 0.0]), (1, [9.0, 0.0]), (2, [8.0, 0.0]), (2, [1e9, 1.0]), (3, [0.5, 0.25])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = kd_search.top_k(v, v.where("vec_id = 3"), 5).orderBy("rank").collect()
    x = [(i, int(128 * np.floor(256 * a) + 64 * np.floor(256 * b))) for i, (a, b) in rows if i != 3]
    assert [(g.vec_id, g.score) for g in got] == sorted(x, key=lambda p: (-p[1], p[0]))


def test_only_wanted_trees_are_sent(spark):
    """A tree goes out once for each block of queries that want it, and not at all where none does."""
    points = spark.range(600).select((F.col("id") % 6).cast("int").alias("leaf"), F.col("id").alias("vec_id"), F.array(*(F.rand(i) for i in range(3))).alias("v"))
    cells = points.select(F.lit(3).alias("dim"), "leaf", F.lit(0).alias("part"), "vec_id", "v")
    trees = cells.groupBy("dim", "leaf", "part").applyInPandas(kd_search._built, "dim int, leaf int, part int, tree binary").cache()
    going = cells.where("leaf < 2 AND vec_id < 90").withColumn("least", F.lit(None).cast("double"))
    n = {r.leaf: r["count"] for r in going.groupBy("leaf").count().collect()}
    for block in (4, 1000):
        found, sent = kd_search._visited(going, trees, 2, block)
        assert {r.leaf: r["count"] for r in sent.groupBy("leaf").count().collect()} == {k: -(-x // block) for k, x in n.items()}
        assert found.count() == 2 * sum(n.values())
