"""Queries over the library's own operators, functions, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import udfs, vectors
from sparkloom.operators import temporal
from sparkloom.sources import calendar, files
from sparkloom.streaming import events as streams
from sparkloom.streaming import state

from .registry import query, table


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTES")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    points = events.select("user_id", F.col("event_id").alias("b"), "ts")
    spans = events.select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("since"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("until"))
    return temporal.interval_join(points, spans, "user_id", "ts", "since", "until", "10 minutes").where("ts > since").select("a", "b")


def _asof(spark: SparkSession, sf_dir: str, tolerance: str | None) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'")
    others = events.where("event_type <> 'click'").drop("event_type")
    return temporal.asof_join(others, clicks, "user_id", "ts", [F.col("event_id").alias("click")], tolerance=tolerance).select("event_id", "match.click")


_ASOF = """
FROM (SELECT * FROM events WHERE event_type <> 'click') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts
"""


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS click FROM events")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's last click so far, itself included."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return temporal.asof_join(events, events.where("event_type = 'click'"), "user_id", "ts", [F.col("event_id").alias("click")]).select("event_id", "match.click")


@query(f"SELECT l.event_id, r.event_id AS click {_ASOF}")
def join_asof_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, None)


@query(f"SELECT l.event_id, CASE WHEN r.ts >= l.ts - INTERVAL 1 HOUR THEN r.event_id END AS click {_ASOF}")
def join_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "1 hour")


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS dot, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def function_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(e, e), 4).alias("dot"), F.round(vectors.norm(e), 4).alias("norm"))


@query("SELECT c_custkey, list_sum(list_transform(range(1, len(c_name) + 1), lambda i: i * ascii(c_name[i])))::BIGINT % 97 AS check FROM customer")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.check_digits("c_name").alias("check"))


@query("SELECT c_custkey, list_sum(list_transform(range(1, len(c_name) + 1), lambda i: i * ascii(c_name[i])))::BIGINT % 97 AS check FROM customer")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.check_digits_arrow("c_name").alias("check"))


@query("SELECT n_nationkey, regexp_replace(n_name, '[AEIOU]', '', 'g') AS short FROM nation")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", udfs.consonants("n_name").alias("short"))


@query("SELECT c_mktsegment, round(median(abs(c_acctbal - m)), 4) AS mad FROM customer JOIN (SELECT c_mktsegment AS s, median(c_acctbal) AS m FROM customer GROUP BY 1) ON c_mktsegment = s GROUP BY c_mktsegment")
def udf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(udfs.mad("c_acctbal"), 4).alias("mad"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x = reverse(x) AND x <> '')) AS palindromes FROM documents")
def udf_map_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.palindromes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) > 0 AS above FROM events")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.above_mean(table(spark, sf_dir, "events"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 10 * c_acctbal GROUP BY c_custkey")
def udf_cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.orders_over(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))


@query("SELECT p_partkey, word, n::INTEGER AS place FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, generate_subscripts(string_split(p_type, ' '), 1) AS n FROM part)")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return parts.lateralJoin(udfs.Words(F.col("p_type").outer())).select("p_partkey", "word", "place")


@query("SELECT d::DATE AS day, dayofweek(d)::INTEGER AS weekday FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY) t(d)")
def source_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.read(spark, 1995, 1998)


def _source(format: str, name: str, *partition_by: str) -> None:
    query(f"SELECT * FROM {name}", f"source_{'partitioned' if partition_by else format}")(lambda spark, sf_dir: files.round_trip(table(spark, sf_dir, name), format, partition_by))


_source("parquet", "orders")
_source("orc", "orders")
_source("json", "customer")
_source("csv", "customer")
_source("xml", "supplier")
_source("parquet", "customer", "c_mktsegment")


@query("SELECT text AS value FROM (SELECT replace(replace(text, chr(13), ' '), chr(10), ' ') AS text FROM benchmark)")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.round_trip(table(spark, sf_dir, "benchmark").select(F.regexp_replace("text", "[\r\n]", " ").alias("value")), "text")


#: What the watermark lets go at the end of input.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.appended(streams.tumbling(streams.source(spark, sf_dir)))


_SLIDING = """
SELECT start, count(*) AS n FROM (
  SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start FROM events
  UNION ALL SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE FROM events)
GROUP BY start
"""


@query(f"{_SLIDING} HAVING start + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.appended(streams.sliding(streams.source(spark, sf_dir)))


@query(_SLIDING)
def time_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("window.start", "n")


_SESSIONS = """
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n
FROM (SELECT *, sum(CASE WHEN ts < before + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
GROUP BY user_id, s
"""


@query(f"{_SESSIONS} HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.appended(streams.sessions(streams.source(spark, sf_dir)))


@query(_SESSIONS)
def time_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", "session_window.start", "session_window.end", "n")


@query("SELECT event_id, user_id, ts FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events twice, each event once."""
    return streams.appended(streams.deduplicated(streams.source(spark, sf_dir).union(streams.source(spark, sf_dir))))


@query("SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTES WHERE a.event_type = 'click' AND b.event_type <> 'click'")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = streams.source(spark, sf_dir).where("event_type = 'click'")
    return streams.appended(streams.followed(clicks, streams.source(spark, sf_dir).where("event_type <> 'click'")))


_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query(_HOURS)
def stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.completed(streams.tumbling(streams.source(spark, sf_dir)))


@query(_HOURS)
def stream_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.updated(streams.tumbling(streams.source(spark, sf_dir)), ["start", "event_type"])


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's count and greatest value in state of our own; the last state of each user is the answer."""
    return streams.updated(state.running(streams.source(spark, sf_dir)), ["user_id"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.in_memory(streams.source(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
