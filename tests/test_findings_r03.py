"""What a review of round 3 found, on tables that show it."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.functions import udfs
from sparkloom.llm import bpe
from sparkloom.llm.queries import tokenizer
from sparkloom.operators import inequality, percentiles, windows
from sparkloom.plans import registry
from sparkloom.streaming import expiring


def against_sql(spark, at, name, **tables):
    """A query's rows and its SQL's, over tables (pandas) that are written to a folder."""
    c = duckdb.connect()
    for t, rows in tables.items():
        c.sql(f"COPY (SELECT * FROM rows) TO '{at}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got = registry.queries()[name](spark, str(at))
    want = c.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda row: tuple((v is not None, v) for v in row)
    return sorted(map(tuple, got.collect()), key=key), sorted((tuple(r[want.columns.index(x)] for x in got.columns) for r in want.fetchall()), key=key)


def chain(edges, suppliers):
    """Tables whose graph has these edges: b is (7 * a + p_size) modulo the suppliers."""
    items = pd.DataFrame({"l_suppkey": [a for a, _ in edges], "l_partkey": range(len(edges)), "l_discount": 0.0, "l_quantity": 50.0})
    parts = pd.DataFrame({"p_partkey": range(len(edges)), "p_size": [(b - 7 * a) % suppliers for a, b in edges]})
    return {"lineitem": items.astype({"l_suppkey": "int64"}), "part": parts.astype({"p_size": "int32"}), "supplier": pd.DataFrame({"s_suppkey": range(suppliers)})}


def test_hops_end_at_forty(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "recursion_hops", **chain([(i, i + 1) for i in range(44)], 100))
    assert got == want and len(got) == 41 and max(h for _, h in got) == 40


def test_hops_without_edges(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "recursion_hops", **chain([], 100))
    assert got == want == [(None, 0)]


def test_above_mean_at_ties_and_nulls(spark):
    """Values that are as large as their user's mean, by order of rows above it or not where sums round."""
    ties = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [0.7] * 10, 4: [1.1, 2.2, 3.3, 2.2], 5: [46.83] * 60, 6: [1.7e308, 1.7e308]}
    odd = {7: [1.0, None, 3.0], 8: [None], 9: [float("nan"), 1.0], 10: [float("inf"), 1.0], 11: [float("inf"), float("-inf")]}
    rows = [(u, 100 * u + i, v) for u, values in (ties | odd).items() for i, v in enumerate(values)]
    got = {r.event_id: r.above for r in udfs.above_mean(spark.createDataFrame(rows, "user_id long, event_id long, value double")).collect()}
    want = {100 * u + i: v > sorted(values)[len(values) // 2] for u, values in ties.items() for i, v in enumerate(values)}
    want |= {700: False, 701: None, 702: True, 800: None, 900: True, 901: True, 1000: True, 1001: False, 1100: True, 1101: True}
    assert got == want


@pytest.mark.parametrize("name", ["approx_distinct", "sketch_hll", "sketch_theta"])
def test_no_sketch_for_each_distinct_value(spark, name):
    """A sketch in an aggregate that is keyed by the distinct values is kept for each of them."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "keys=[l_partkey" in plan or "keys=[o_custkey" in plan
    assert not [x for x in plan.splitlines() if "Aggregate(keys=[l_partkey" in x or "Aggregate(keys=[o_custkey" in x if "approx_count" in x or "sketch" in x]


@pytest.mark.parametrize(("small", "few"), [(10, 1000), (10, 2), (10_000, 1000)])
def test_percentiles_of_small_and_large_groups(spark, monkeypatch, small, few):
    monkeypatch.setattr(percentiles, "FEW", few)
    groups = {k: [float((i * 7919 + (k or 5) * 31) % 101) / 4 for i in range(3 * (k or 4))] for k in (None, 1, 2, 3, 4, 10, 40)} | {6: [float("inf"), 2.0, float("-inf")] * 6}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in x] + [(7, None), (7, float("nan")), (10, None), (1, float("nan"))], "k int, v double")
    at = [0.0, 0.3, 0.9, 1.0]
    got = {(x.k, x.p): x.percentile for x in percentiles.exact_percentiles(df, ["k"], "v", at, 3, small).collect()}
    assert len(got) == 4 * 9 and all(got[7, p] is None for p in at)
    for k, x in groups.items():
        for p in at:
            s, place = sorted(x), p * (len(x) - 1)
            a, b, share = s[int(place)], s[min(int(place) + 1, len(s) - 1)], place - int(place)
            assert got[k, p] == pytest.approx(a if share == 0 or a == b else a * (1 - share) + b * share, nan_ok=True), (k, p)


def test_many_groups_are_not_broadcast(spark):
    """20,000 groups: no more than a little goes through the driver."""
    df = spark.range(200_000).select((F.col("id") % 20_000).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        assert percentiles.exact_percentiles(df, ["k"], "v", [0.9]).where("percentile IS NOT NULL").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("hours", [0, 2, 30])
def test_range_extremes(spark, hours):
    """Null keys, times and values, NaNs, ties, and times that fall on the ends of frames."""
    r = random.Random(3)
    value = lambda: r.choice([None, float("nan"), *range(-30, 30)])
    rows = [(i, r.choice([None, "a", "b"]), None if r.random() < 0.05 else dt.datetime(1970, 1, 2) + dt.timedelta(minutes=30 * r.randint(-150, 150)), None if (v := value()) is None else float(v)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, v double")
    got = {x.id: (x.least, x.most) for x in windows.range_extremes(df, ["key"], "ts", dt.timedelta(hours=hours), least={"least": "v"}, most={"most": "v"}).collect()}
    order = lambda v: (v != v, v)
    for i, key, ts, _ in rows:
        frame = [v for _, k, t, v in rows if k == key and v is not None and (t is None if ts is None else t is not None and ts - dt.timedelta(hours=hours) <= t <= ts)]
        assert repr(got[i]) == repr((min(frame, key=order), max(frame, key=order)) if frame else (None, None)), i
    assert len(got) == len(rows)
    assert windows.range_extremes(df.where("false"), ["key"], "ts", dt.timedelta(hours=1), least={"least": "v"}).count() == 0


def test_frames_are_not_looked_through_for_each_row(spark):
    """Spark goes through a frame with two moving ends again for each row."""
    plan = registry.queries()["split_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan


def test_orders_over_comes_in_large_groups(spark, tmp_path, monkeypatch):
    """Fewer groups than customers, and rows as SQL has them with repeated and null keys, null and NaN prices and balances."""
    r = random.Random(8)
    some = lambda *odd: r.choice([*odd, *range(-5, 60)])
    nan = float("nan")
    customer = [(None if k == 0 else k, some(None, nan, None)) for k in [*range(200), 7, 7, 0]]
    orders = [(i, None if r.random() < 0.05 else r.randint(1, 220), None if r.random() < 0.05 else nan if r.random() < 0.05 else 10.0 * some()) for i in range(1500)]
    c = spark.createDataFrame([(k, None if b is None else float(b)) for k, b in customer], "c_custkey long, c_acctbal double")
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double")
    for name, df in (("customer", c), ("orders", o)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    for name in ("customer", "orders"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = dict(duck.sql(registry.oracle_sql()["udf_cogrouped"]).fetchall())
    for rows in (50, 5_000):
        monkeypatch.setattr(udfs, "GROUP_ROWS", rows)
        got = registry.queries()["udf_cogrouped"](spark, str(tmp_path)).collect()
        assert dict(map(tuple, got)) == want and len(got) == len(want)
    groups = registry.queries()["udf_cogrouped"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert groups.count("hashpartitioning(group#") == 2
    assert registry.queries()["udf_cogrouped"](spark, "/root/testdata/sf0.001").where("n IS NULL").count() == udfs.orders_over(c.where("false"), o).count() == 0
    assert udfs.orders_over(c, o.where("false")).where("n = 0").count() == len(want)


class Asked:
    """A state that counts how often it is asked."""

    def __init__(self, held=None):
        self.held, self.calls = held, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "updateValue":
                self.held[args[0]] = args[1]
            elif name == "put":
                self.held = args[0]
            return iter(self.held.items() if name == "iterator" else self.held) if name in ("iterator", "get") else self.held.get(args[0]) if name == "getValue" else None

        return call


def test_state_is_asked_seldom_and_keeps_the_newest(spark):
    at = lambda *hours: pd.to_datetime([f"2024-01-01 {h:02}:00" for h in hours])
    part = lambda kinds, values, hours: pd.DataFrame({"event_type": kinds, "value": values, "ts": at(*hours)})
    one = expiring.Counts(None)
    one.counts, one.newest = Asked({("b",): (2,)}), Asked([(9.0,)])
    out = list(one.handleInputRows((1,), iter([part(["a", "b", None], [1.0, 2.0, None], [9, 10, 11]), part(["c", "d", "e"], [3.0, 4.0, 5.0], [1, 2, 3])]), None))
    assert sum(map(len, out)) == 0  # nobody reads rows
    assert one.counts.held == {("a",): (1,), ("b",): (3,), ("",): (1,), ("c",): (1,), ("d",): (1,), ("e",): (1,)} and one.counts.calls == 7
    assert one.newest.held == [(5.0,), (1.0,), (2.0,)] and one.newest.calls == 1
    list(one.handleInputRows((1,), iter([part(["a"], [7.0], [12])]), None))
    assert one.newest.held == [(1.0,), (2.0,), (7.0,)] and one.counts.held["a",] == (2,)


def test_inequality_join_shuffles_what_is_wanted(spark):
    left, right = spark.range(50).selectExpr("id AS a", "id % 7 AS x", "'left alone' AS more"), spark.range(60).selectExpr("id AS b", "id % 9 AS p", "'right alone' AS other")
    for wanted in (["a", "b"], ["b"], ["a", "p"]):
        got = inequality.inequality_join(left, right, [("x", "<", "p")], 10, 20, wanted=wanted)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "left alone" not in plan and "right alone" not in plan
        met = left.join(right, F.expr("x < p")).select(wanted)
        assert got.columns == wanted and sorted(map(tuple, got.collect())) == sorted(map(tuple, met.collect()))


def test_bpe_keeps_the_pieces_of_a_large_vocabulary(monkeypatch):
    """100,000 pieces, 25 MB or so, are encoded once, though batches between ask for others."""
    one, asked = bpe.Codec(tokenizer("byte_bpe_50k.json")), []
    monkeypatch.setattr(one, "encode_pieces", lambda pieces: asked.extend(pieces) or [[0]] * len(pieces))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(100_000)]
    for batch in (words, ["other"], words, ["more"]):
        one.run([" " + " ".join(batch)])
    assert len(asked) == len(set(asked)) >= 100_000
