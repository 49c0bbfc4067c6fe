"""Split windows, inequality joins, percentiles by rounds, recursion, expiring state, the journal, table functions, frequent items, samples and peer frames against plain Python, on small fixtures with nulls, ties, repeats, hot keys and no rows."""

import collections
import datetime as dt
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.functions import table_functions
from sparkloom.operators import frequent, inequality, peers, percentiles, recursion, sampling, windows
from sparkloom.sources import journal
from sparkloom.sources.shared import fresh_path
from sparkloom.streaming import expiring

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture(scope="module")
def data():
    """(id, key, time, value): a key with a third of all rows, null keys, times and values, ties."""
    r = random.Random(1)
    out = []
    for i in range(400):
        key = "hot" if i % 3 == 0 else r.choice([None, "a", "b", "c"])
        time = None if r.random() < 0.05 else START + dt.timedelta(minutes=15 * r.randint(0, 200))
        out.append((i, key, time, None if r.random() < 0.1 else r.randint(-50, 50)))
    return out


@pytest.fixture(scope="module")
def events(spark, data):
    return spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, v long").cache()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    events = pd.DataFrame(data, columns=["id", "key", "ts", "v"]).astype({"v": "Int64"})  # noqa: F841
    c.sql("CREATE TABLE events AS SELECT id, key, ts::TIMESTAMP AS ts, v FROM events")
    return c


def same(got, duck, sql):
    want = duck.sql(sql)
    names = got.columns
    assert sorted(names) == sorted(want.columns)
    rows = collections.Counter(map(tuple, got.collect()))
    assert rows == collections.Counter(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())
    assert sum(rows.values()) > 0


ORDER = "PARTITION BY key ORDER BY ts NULLS FIRST, id"
SIZES = [HOUR, 24 * HOUR, 24 * 365 * HOUR]


@pytest.mark.parametrize("size", SIZES)
def test_running(events, duck, size):
    got = windows.running(events, ["key"], ["ts", "id"], windows.buckets("ts", size), sums={"s": "v"}, counts={"n": "v"}, least={"lo": "v"}, most={"hi": "v"})
    w = f"OVER ({ORDER} ROWS UNBOUNDED PRECEDING)"
    same(got, duck, f"SELECT *, sum(v) {w}::BIGINT AS s, count(v) {w} AS n, min(v) {w} AS lo, max(v) {w} AS hi FROM events")
    whole = windows.running(events, [], ["ts", "id"], windows.buckets("ts", size), counts={"n": "id"}).select("id", "n")
    same(whole, duck, "SELECT id, count(*) OVER (ORDER BY ts NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS n FROM events")


@pytest.mark.parametrize("size", SIZES)
def test_ranks(events, duck, size):
    got = windows.ranked(events, ["key"], ["ts"], windows.buckets("ts", size)).drop("row_number")
    same(got, duck, "SELECT *, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM events WINDOW w AS (PARTITION BY key ORDER BY ts NULLS FIRST)")
    number = windows.ranked(events, ["key"], ["ts", "id"], windows.buckets("ts", size)).select("id", "row_number")
    same(number, duck, f"SELECT id, row_number() OVER ({ORDER}) AS row_number FROM events")


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("back", [1, 5])
def test_rows_frame(events, duck, size, back):
    made = lambda w: {"before": F.lag("v", back).over(w), "s": F.sum("v").over(w.rowsBetween(-back, 0)), "hi": F.max("v").over(w.rowsBetween(-back, -1))}
    got = windows.rows_frame(events, ["key"], ["ts", "id"], windows.buckets("ts", size), back, ["v"], made)
    w = f"OVER ({ORDER} ROWS BETWEEN {back} PRECEDING AND"
    same(got, duck, f"SELECT *, lag(v, {back}) OVER ({ORDER}) AS before, sum(v) {w} CURRENT ROW)::BIGINT AS s, max(v) {w} 1 PRECEDING) AS hi FROM events")


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("hours", [0, 2, 30])
def test_range_frames(events, duck, size, hours):
    w = f"OVER (PARTITION BY key ORDER BY ts NULLS FIRST RANGE BETWEEN INTERVAL {hours} HOURS PRECEDING AND CURRENT ROW)"
    sql = f"SELECT *, sum(v) {w}::BIGINT AS s, count(v) {w} AS n FROM events"
    same(windows.range_frame(events, ["key"], "ts", hours * HOUR, size, lambda w: {"s": F.sum("v").over(w), "n": F.count("v").over(w)}), duck, sql)
    same(windows.range_sums(events, ["key"], "ts", hours * HOUR, size, sums={"s": "v"}, counts={"n": "v"}), duck, sql)


def test_windows_of_nothing(events):
    none, bucket = events.where("false"), windows.buckets("ts", HOUR)
    assert windows.running(none, ["key"], ["ts"], bucket, sums={"s": "v"}).count() == 0
    assert windows.ranked(none, ["key"], ["ts"], bucket).count() == 0
    assert windows.rows_frame(none, ["key"], ["ts"], bucket, 2, ["v"], lambda w: {"x": F.lag("v").over(w)}).count() == 0
    assert windows.range_sums(none, ["key"], "ts", HOUR, HOUR, counts={"n": "v"}).count() == 0


def test_hot_key_is_spread(spark):
    """The rows of one key go through its window by bucket: no task has more than a bucket's."""
    rows = spark.range(4000).select(F.lit("hot").alias("key"), "id", (F.lit(START) + F.expr("make_interval(0, 0, 0, 0, cast(id AS INT))")).cast("timestamp_ntz").alias("ts"))
    out = windows.running(rows, ["key"], ["ts", "id"], windows.buckets("ts", 24 * HOUR), counts={"n": "id"})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 2500 and out.agg(F.sum("n")).first()[0] == 4000 * 4001 // 2


@pytest.mark.parametrize("exclude", peers.EXCLUDE)
@pytest.mark.parametrize("width", [1, 1000])
def test_peers(events, duck, exclude, width):
    made = peers.groups_frame(events.withColumn("o", F.floor(F.col("v") / 10)), ["key"], "o", F.floor(F.col("o") / width), 2, "v", exclude).select("id", "n", "total")
    w = f"OVER (PARTITION BY key ORDER BY floor(v / 10) NULLS FIRST GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE {exclude.upper()})"
    same(made, duck, f"SELECT id, count(v) {w} AS n, sum(v) {w}::BIGINT AS total FROM events")
    with pytest.raises(ValueError):
        peers.groups_frame(events, ["key"], "v", F.lit(0), 2, "v", "none")


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(9)
    value = lambda: None if r.random() < 0.05 else float("nan") if r.random() < 0.03 else float(r.choice([7, 7, 7, *range(-40, 40)])) / 2
    left, right = ([(i, value(), value()) for i in range(n)] for n in (150, 220))
    left += left[:20]
    return left, right, spark.createDataFrame(left, "a long, x double, y double"), spark.createDataFrame(right, "b long, p double, q double")


@pytest.mark.parametrize("conditions", [[("x", "<", "p")], [("x", ">=", "p")], [("x", "<=", "p"), ("y", ">", "p")], [("x", ">", "p"), ("y", "<=", "q")], [("x", "<", "q"), ("y", ">", "q"), ("x", ">=", "p")]])
@pytest.mark.parametrize("rows", [5, 40, 1000])
def test_inequality_join(sides, conditions, rows):
    left, right, l, r = sides
    got = inequality.inequality_join(l, r, conditions, rows, 3 * rows)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    at = {"x": 1, "y": 2, "p": 1, "q": 2}
    want = collections.Counter()
    for a, b in itertools.product(left, right):
        if all(a[at[c]] is not None and b[at[d]] is not None and OPS[op](a[at[c]], b[at[d]]) for c, op, d in conditions):
            want[a[0], b[0]] += 1
    assert collections.Counter((x.a, x.b) for x in got.collect()) == want and want


def test_inequality_join_of_times_and_nothing(spark, events, sides):
    a = events.select("id", F.col("ts").alias("since"))
    b = events.select(F.col("id").alias("other"), F.col("ts").alias("at"))
    rows = [(r.id, r.ts) for r in events.collect() if r.ts]
    got = inequality.inequality_join(a.where("id < 50"), b, [("since", "<", "at")], 30)
    assert {(x.id, x.other) for x in got.collect()} == {(i, j) for i, s in rows if i < 50 for j, t in rows if s < t}
    _, _, l, r = sides
    for x, y in ((l.where("false"), r), (l, r.where("false"))):
        assert inequality.inequality_join(x, y, [("x", "<", "p")]).count() == 0
    assert inequality.inequality_sums(l, r.where("false"), ("x", "<", "p"), {"s": "q"}, "n").where("n = 0 AND s IS NULL").count() == l.count()


@pytest.mark.parametrize("op", list(OPS))
@pytest.mark.parametrize("rows", [7, 1000])
def test_inequality_sums(sides, op, rows):
    left, right, l, r = sides
    got = inequality.inequality_sums(l, r.withColumn("k", F.col("b") % 10), ("x", op, "p"), {"s": "k"}, "n", rows)
    want = collections.Counter()
    for a in left:
        met = [b for b in right if None not in (a[1], b[1]) and a[1] == a[1] and b[1] == b[1] and OPS[op](a[1], b[1])]
        want[a[0], len(met), sum(b[0] % 10 for b in met) if met else None] += 1
    assert collections.Counter((x.a, x.n, x.s) for x in got.collect()) == want


@pytest.mark.parametrize("grid", [2, 5, 64])
def test_percentiles(spark, grid):
    r = random.Random(4)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 300, "hot": [r.gauss(0, 1) * 10 ** r.randint(-3, 9) for _ in range(900)] + [float("inf"), float("-inf")], "few": [r.randint(0, 9) / 2 for _ in range(80)], None: [1.0, 4.0, 9.0]}
    rows = [(k, v) for k, x in groups.items() for v in x] + [("none", None), ("none", float("nan")), ("two", None), ("few", float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    at = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {(x.k, x.p): x.percentile for x in percentiles.exact_percentiles(df, ["k"], "v", at, grid).collect()}
    assert len(got) == 5 * (len(groups) + 1)
    for k, x in groups.items():
        s = sorted(x)
        for p in at:
            place = p * (len(s) - 1)
            lo = int(place)
            hi, share = min(lo + 1, len(s) - 1), place - lo
            want = s[lo] if share == 0 or s[lo] == s[hi] else s[lo] * (1 - share) + s[hi] * share
            assert got[k, p] == pytest.approx(want, rel=1e-12, nan_ok=True), (k, p)
    assert all(got["none", p] is None for p in at)
    assert percentiles.exact_percentiles(df.where("false"), ["k"], "v", [0.5]).count() == 0
    whole = percentiles.exact_percentiles(df.where("k = 'few'"), [], "v", [0.5], grid).collect()
    assert [x.percentile for x in whole] == [float(np.median(groups["few"]))]


def test_recursion(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 4), (10, 11), (None, 5), (4, None), *[(k, k + 1) for k in range(20, 60)], (60, 20)]
    e = spark.createDataFrame(edges, "a long, b long")
    hop = lambda new: new.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("hops") + 1).alias("hops"))
    seed = spark.createDataFrame([(0, 0), (20, 0), (0, 5)], "node long, hops long")
    got = {r.node: r.hops for r in recursion.closure(seed, hop, ["node"]).collect()}
    want, new = {0: 0, 20: 0}, [0, 20]
    while new:
        new = [b for n in new for a, b in edges if a == n is not None and b not in want and (want.__setitem__(b, want[n] + 1) is None)]
    assert got == want
    assert recursion.closure(seed.where("false"), hop, ["node"]).count() == 0
    with pytest.raises(RuntimeError):
        recursion.closure(seed, lambda new: new.select((F.col("node") + 1).alias("node"), "hops"), ["node"], 3)
    found = {r.node: r.component for r in recursion.components(e, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(5), 0), 10: 10, 11: 10, **dict.fromkeys(range(20, 61), 20)}
    assert recursion.components(e.where("false"), "a", "b").count() == 0
    assert recursion.digest(e) == recursion.digest(e.repartition(3)) != recursion.digest(e.where("a IS NULL OR a > 0"))


def test_state_expires(spark, events):
    source, path, rows = events.withColumnsRenamed({"id": "user_id", "key": "event_type"}).withColumns({"user_id": F.col("user_id") % 5, "value": F.col("v").cast("double")}), fresh_path(spark, "state"), fresh_path(spark, "events")
    count = lambda part: {(r.user_id, r.event_type or ""): r["count"] for r in source.where(part).groupBy("user_id", "event_type").count().collect()}
    state = lambda: {(r.user_id, r.event_type): r.n for r in expiring.held(spark, path).collect()}

    def run(part, ttl):
        source.where(part).coalesce(1).write.mode("append").parquet(rows)
        expiring.counted(spark.readStream.schema(source.schema).parquet(rows), path, ttl)

    run("v < 0", 3_600_000)
    assert state() == count("v < 0") and expiring.held(spark, path).where("until IS NULL").count() == 0
    run("v >= 0", 3_600_000)  # nothing has expired
    assert state() == count("v IS NOT NULL")
    kept = collections.Counter(r.user_id for r in expiring.newest(spark, path).collect())
    assert kept == {u: expiring.NEWEST for u in range(5)}


def test_journal(spark, events):
    path = fresh_path(spark, "journal")
    with pytest.raises(Exception, match="no version"):
        journal.read(spark, path)
    parts = [events.where("v < 0"), events.where("v >= 0").repartitionByRange(3, "v"), events.where("v IS NULL"), events.where("false")]
    for p in parts:
        journal.write(p, path)
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    assert rows(journal.read(spark, path)) == rows(events) and len(journal.versions(path)) == 4
    for test in ("v > 20", "v = -7", "v <= -49", "v IS NULL", "ts >= timestamp_ntz'2024-01-02 00:00:00'", "key = 'hot'", "v > 1000", "key < 'b' AND v > 0"):
        assert rows(journal.read(spark, path).where(test)) == rows(events.where(test)), test
    reader = journal.Reader(path, events.schema)
    every = len(reader.partitions())
    reader.pushFilters([journal.GreaterThan(("v",), 40)])
    assert 1 <= len(reader.partitions()) < every
    reader.pushFilters([journal.GreaterThan(("v",), 400)])
    assert [p.file for p in reader.partitions()] == [""]
    # a job whose task fails leaves no rows, and the next one is fine
    fails = F.udf(lambda i: i if i < 390 else 1 / 0, "long")
    with pytest.raises(Exception, match="ZeroDivision|division by zero"):
        journal.write(events.withColumn("id", fails("id")).repartition(4), path)
    assert rows(journal.read(spark, path)) == rows(events)
    journal.write(events.where("v = 1"), path, "overwrite")
    assert rows(journal.read(spark, path)) == rows(events.where("v = 1"))


def test_journal_stream(spark, events):
    path, state = fresh_path(spark, "journal"), fresh_path(spark, "stream")

    def run():
        q = journal.stream(spark, path).writeStream.format("parquet").option("path", f"{state}/rows").option("checkpointLocation", f"{state}/state")
        q.trigger(availableNow=True).start().awaitTermination()
        return collections.Counter(map(tuple, spark.read.schema(events.schema).parquet(f"{state}/rows").collect()))

    journal.write(events.where("v < 0"), path)
    assert run() == collections.Counter(map(tuple, events.where("v < 0").collect()))
    journal.write(events.where("v >= 0"), path)
    journal.write(events.where("v IS NULL"), path)
    assert run() == run() == collections.Counter(map(tuple, events.collect()))
    with pytest.raises(ValueError):
        versions = len(journal.versions(path))
        journal.write(events, path, "overwrite")
        journal.StreamReader(path, events.schema).partitions({"version": versions}, {"version": versions + 1})


def test_sessions(spark, events, data):
    got = collections.Counter(map(tuple, table_functions.sessions(events, "key", "ts", 45).collect()))
    want = collections.Counter()
    for key in {k for _, k, _, _ in data}:
        times = sorted(t for _, k, t, _ in data if k == key and t)
        number, start, last, n = 0, None, None, 0
        for t in [*times, None]:
            if last is not None and (t is None or t - last >= dt.timedelta(minutes=45)):
                want[key, number, start, last, n] += 1
                last = None
            if t is not None:
                if last is None:
                    number, start, n = number + 1, t, 0
                last, n = t, n + 1
    assert got == want
    assert table_functions.sessions(events.where("false"), "key", "ts", 45).count() == 0
    with pytest.raises(Exception, match="time without zone"):
        table_functions.sessions(events, "key", "v", 45)
    spark.udtf.register("own_sessions", table_functions.Sessions)
    events.createOrReplaceTempView("own_events")
    assert spark.sql("SELECT * FROM own_sessions(TABLE(own_events), 'key', 'ts', 45)").count() == sum(want.values())
    spark.catalog.dropTempView("own_events")


def test_largest(spark):
    vectors = [(1, [3.0, None, 5.0, 5.0, float("nan")]), (2, None), (3, []), (4, [1.0]), (5, [2.0, 1.0, 0.0, -1.0]), (None, [9.0])]
    got = table_functions.largest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), 2).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 5.0), (1, 2, 3, 5.0), (4, 1, 0, 1.0), (5, 1, 0, 2.0), (5, 2, 1, 1.0)]
    assert table_functions.largest(spark.createDataFrame(vectors[:0], "vec_id long, embedding array<float>"), 2).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.02, 0.001])
def test_frequent(spark, share):
    r = random.Random(6)
    items = ["hot"] * 2000 + [f"w{int(r.paretovariate(0.9))}" for _ in range(4000)] + [None] * 500
    r.shuffle(items)
    got = {x.w: x.n for x in frequent.frequent(spark.createDataFrame([(w,) for w in items], "w string").repartition(7), "w", share).collect()}
    count = collections.Counter(w for w in items if w)
    assert got == {w: n for w, n in count.items() if n >= share * 6000} and "hot" in got
    numbers = frequent.frequent(spark.range(1000).select((F.col("id") % 3).alias("k")), "k", 0.333)
    assert {x.k: x.n for x in numbers.collect()} == {0: 334, 1: 333, 2: 333}


def test_frequent_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "w string")
    assert frequent.frequent(df, "w", 0.1).count() == frequent.frequent(df.where("false"), "w", 0.1).count() == 0
    with pytest.raises(ValueError):
        frequent.frequent(df, "w", 0)


def test_samples(spark, events, data):
    sizes = collections.Counter(k for _, k, _, _ in data)
    keys = lambda df: {r.id for r in df.collect()}
    strata = lambda df: collections.Counter(r.key for r in df.collect())
    for make, want in (
        (lambda df, seed: sampling.per_stratum(df, ["key"], 20, ["id"], seed), dict.fromkeys(sizes, 20)),
        (lambda df, seed: sampling.share_of_strata(df, ["key"], 0.3, ["id"], seed), {k: int(0.3 * n) for k, n in sizes.items()}),
        (lambda df, seed: sampling.weighted(df, ["key"], 9, "v", ["id"], seed), dict.fromkeys(sizes, 9)),
    ):
        one = make(events, 1)
        assert strata(one) == want and one.columns == events.columns
        assert keys(one) == keys(make(events.repartition(7), 1)) == keys(make(events.orderBy("v"), 1)) != keys(make(events, 2))
        assert make(events.where("false"), 1).count() == 0
    assert sampling.per_stratum(events, ["key"], 1000, ["id"]).count() == 400
    assert sampling.weighted(events, [], 1000, "v", ["id"]).count() == sum(v is not None and v > 0 for *_, v in data)
    twins = spark.createDataFrame([Row(id=1, key="x")] * 10)
    assert sampling.per_stratum(twins, ["key"], 4, ["id"]).count() == 4 and sampling.share_of_strata(twins, ["key"], 0.55, ["id"]).count() == 5


def test_weights_count(spark):
    """Of many draws, an item of weight 9 comes out nine times as often as one of weight 1."""
    rows = spark.range(20000).select("id", F.floor(F.col("id") / 2).alias("s"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("w"))
    heavy = sampling.weighted(rows, ["s"], 1, "w", ["id"]).where("w = 9").count()
    assert 8850 < heavy < 9150
