"""Operators, functions, sources and streams on small fixtures with nulls, ties, repeats and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import udfs, vectors
from sparkloom.operators import temporal, text_joins
from sparkloom.sources import calendar, files
from sparkloom.sources.shared import fresh_path
from sparkloom.streaming import events as streams
from sparkloom.streaming import state

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def rows(spark, data):
    """(id, user, minutes) as a table."""
    return spark.createDataFrame([(i, u, at(m)) for i, u, m in data], "id long, user long, ts timestamp_ntz")


LEFT = [(1, 1, 0), (2, 1, 30), (3, 1, 5000), (4, 2, 10), (5, None, 10), (6, 1, None), (7, 1, 30), (7, 1, 30), (8, 3, 10)]
RIGHT = [(10, 1, 20), (11, 1, 30), (12, 1, 30), (13, 2, 11), (14, None, 5), (15, 1, None), (16, 3, 10)]


@pytest.mark.parametrize("bucket", ["5 minutes", "1 hour", "30 days"])
@pytest.mark.parametrize("tolerance", [None, 60])
def test_asof(spark, bucket, tolerance):
    left, right = rows(spark, LEFT), rows(spark, RIGHT)
    got = temporal.asof_join(left, right, "user", "ts", [F.col("id").alias("hit")], bucket, tolerance and f"{tolerance} MINUTES")
    want = []
    for i, u, m in LEFT:
        best = max(((t, j) for j, v, t in RIGHT if None not in (u, m, v, t) and u == v and t <= m and (not tolerance or t >= m - tolerance)), default=None)
        want.append((i, best and best[1]))
    key = lambda x: (x[0], x[1] or 0)
    assert sorted(((r.id, r.match and r.match.hit) for r in got.collect()), key=key) == sorted(want, key=key)
    none = temporal.asof_join(left, right.where("id < 0"), "user", "ts", [F.col("id").alias("hit")], bucket)
    assert none.count() == len(LEFT) and none.where("match is not null").count() == 0
    assert temporal.asof_join(left.where("id < 0"), right, "user", "ts", [F.col("id")], bucket).count() == 0


@pytest.mark.parametrize("bucket", ["5 minutes", "1 day"])
def test_interval_join(spark, bucket):
    spans = [(20, 1, 0, 30), (21, 1, 30, 30), (22, 1, 40, 10), (23, 2, None, 50), (24, None, 0, 90), (25, 2, 10, 9000)]
    i = spark.createDataFrame([(i, u, at(a), at(z)) for i, u, a, z in spans], "span long, user long, since timestamp_ntz, until timestamp_ntz")
    got = temporal.interval_join(rows(spark, LEFT), i, "user", "ts", "since", "until", bucket)
    want = [(j, k) for j, u, m in LEFT for k, v, a, z in spans if None not in (u, m, v, a, z) and u == v and a <= m <= z]
    assert sorted((r.id, r.span) for r in got.collect()) == sorted(want)


def test_vectors(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, None, [1.0]), (4, [1.0, None], [1.0, 1.0]), (5, [1.0], [1.0, 2.0])], "id int, a array<float>, b array<float>")
    got = {r.id: r.c for r in d.select("id", vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {1: pytest.approx(0.96), 2: None, 3: None, 4: None, 5: None}


def test_udfs(spark):
    d = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "é")], "id int, name string")
    for f in (udfs.check_digits, udfs.check_digits_arrow):
        assert {r.id: r.i for r in d.select("id", f("name").alias("i")).collect()} == {1: (97 + 2 * 98) % 97, 2: 0, 3: None, 4: 233 % 97}
    assert {r.id: r.palindromes for r in udfs.palindromes(spark.createDataFrame([(1, "aba\nab\n\nx"), (2, None)], "id int, name string"), "id", "name").collect()} == {1: 2, 2: 0}
    v = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, 9.0), (1, None), (2, None)], "k int, v double")
    assert {r.k: r.m for r in v.groupBy("k").agg(udfs.mad("v").alias("m")).collect()} == {1: 3.0, 2: None}
    w = d.lateralJoin(udfs.Words(F.col("name").outer())).select("id", "word", "place").collect()
    assert sorted((r.id, r.word, r.place) for r in w) == [(1, "ab", 1), (2, "", 1), (4, "é", 1)]


def test_containment_join(spark):
    t = [(1, "the big red house"), (2, "a big redder house"), (3, None), (4, ""), (5, "red")]
    p = [(10, "big red house"), (11, "big red h"), (12, "red"), (13, ""), (14, None), (15, "e big r"), (16, "x  y")]
    got = text_joins.containment_join(spark.createDataFrame(t, "id int, text string"), spark.createDataFrame(p, "part int, text string"), "text").collect()
    assert sorted((r.id, r.part) for r in got) == sorted((i, j) for i, x in t for j, y in p if None not in (x, y) and y in x)


def test_custom_source(spark):
    assert calendar.read(spark, 2023, 2024).count() == 731
    assert calendar.read(spark, 2024, 2023).count() == 0


def test_stream_modes(spark):
    path = _event_files(spark, [[(1, 1, 5), (2, 1, 10)], [(3, 1, 30), (4, 2, 100)]])
    source = lambda: streams.source(spark, path, files_per_batch=1)
    for got in (streams.completed(streams.tumbling(source())), streams.updated(streams.tumbling(source()), ["start", "event_type"])):
        assert {r.start: r.n for r in got.collect()} == {at(0): 3, at(60): 1}
    assert {r.user_id: (r.n, r.most) for r in streams.updated(state.running(source()), ["user_id"]).collect()} == {1: (3, 1.0), 2: (1, 1.0)}


def test_state_is_let_go_by_its_timer(spark):
    day = 24 * 60
    path = _event_files(spark, [[(1, 1, 0)], [(2, 2, 200 * day)], [(3, 2, 201 * day)], [(4, 1, 202 * day)]])
    got = {r.user_id: r.n for r in streams.updated(state.running(streams.source(spark, path, files_per_batch=1)), ["user_id"]).collect()}
    assert got == {1: 1, 2: 2}


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats(spark, format):
    data = [(1, "a", 0.1), (2, 'x"y,\nz', None), (3, None, 1e300), (4, "", -0.0)]
    d = spark.createDataFrame(data, "id int, s string, v double")
    assert sorted(map(tuple, files.round_trip(d, format).collect())) == data
    assert files.round_trip(d.where("id < 0"), format).count() == 0


def test_partitioned_scan_is_pruned(spark):
    d = spark.range(100).withColumn("part", F.col("id") % 4)
    path = fresh_path(spark, "parts")
    files.write(d, path, "parquet", ("part",))
    back = files.read(spark, path, d.schema)
    assert back.where("part = 3").count() == 25
    assert "PartitionFilters: [isnotnull(part" in back.where("part = 3")._jdf.queryExecution().toString()


def _event_files(spark, batches):
    """A folder of events, one file a batch, in this order of time."""
    path = fresh_path(spark, "events")
    for b in batches:
        d = spark.createDataFrame([(i, at(m), u, "click", 1.0, "{}") for i, u, m in b], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        d.coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


def test_late_rows_are_dropped_after_the_watermark(spark):
    path = _event_files(spark, [[(1, 1, 5), (2, 1, 10)], [(3, 1, 300)], [(4, 1, 7), (5, 1, 310)], [(6, 1, 8), (7, 1, 600)]])
    got = streams.appended(streams.tumbling(streams.source(spark, path, files_per_batch=1)))
    closed = {r.start: r.n for r in got.collect()}
    # late rows are told by the watermark of the batch before: 4 came with the batch that closed its hour, 6 after it; 7's hour is open
    assert closed == {at(0): 3, at(300): 2}


def test_stream_goes_on_where_it_ended(spark):
    path, out = _event_files(spark, [[(1, 1, 0), (2, 2, 1), (1, 1, 0)]]), fresh_path(spark, "stream")
    first = lambda: streams.appended(streams.deduplicated(streams.source(spark, path)), out)
    assert sorted(r.event_id for r in first().collect()) == [1, 2]
    spark.createDataFrame([(3, at(2), 1, "click", 1.0, "{}"), (1, at(0), 1, "click", 1.0, "{}")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.mode("append").parquet(f"{path}/events.parquet")
    assert sorted(r.event_id for r in first().collect()) == [1, 2, 3]


def test_not_in_with_nulls(spark):
    """A null among the excluded keys lets nothing through; a null key comes through only where no key is excluded."""
    from sparkloom.plans import registry

    path = fresh_path(spark, "tables")
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    orders = spark.createDataFrame([(1, 300000.0), (2, 5.0), (None, 7.0)], "o_custkey long, o_totalprice double")
    orders.write.parquet(f"{path}/orders.parquet")
    run = registry.queries()["join_not_in"]
    assert sorted(r.c_custkey for r in run(spark, path).collect()) == [2, 3]
    orders.unionByName(spark.createDataFrame([(None, 900000.0)], orders.schema)).write.parquet(f"{path}/more/orders.parquet")
    spark.read.parquet(f"{path}/customer.parquet").write.parquet(f"{path}/more/customer.parquet")
    assert run(spark, f"{path}/more").collect() == []
    with_null = spark.createDataFrame([(1,), (None,)], "c_custkey long")
    for at, some in (("none", orders.where("o_totalprice < 100000")), ("some", orders)):
        with_null.write.parquet(f"{path}/{at}/customer.parquet")
        some.write.parquet(f"{path}/{at}/orders.parquet")
    assert {r.c_custkey for r in run(spark, f"{path}/none").collect()} == {1, None}
    assert run(spark, f"{path}/some").collect() == []
