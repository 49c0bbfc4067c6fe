"""Further relational queries, written in SQL that Spark plans; DuckDB's form is given where it differs.

They cover the candidates of the survey's inventory; the reference gives no source to take a scope from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .registry import query, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs sql over the tables it names; they are bound as arguments, so no view is left behind."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    bound = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", sql) if used else sql
    return spark.sql(bound, **{t: table(spark, sf_dir, t) for t in used if f"{{{t}}}" in bound})


def add(name: str, sql: str, duck: str | None = None) -> None:
    query(duck or sql, name)(lambda spark, sf_dir: run_sql(spark, sf_dir, sql))


# Filters, projections, reshaping.
add("filter_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
add("filter_time", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'")
add("explode_words", "SELECT word, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS word FROM benchmark) GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY word")
add("pivot_status", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS f FROM lineitem GROUP BY l_returnflag")
add("unpivot_part", "SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
# Joins.
add("join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
add("join_five_tables", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey AND r_name = 'ASIA' GROUP BY n_name")
add("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey")
add("join_left", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
add("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
add("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
add(  # the null tests apart, so that the rest is an anti join by key and no subquery is broadcast whole; a null key is in no empty set
    "join_not_in",
    "SELECT c_custkey FROM customer WHERE (c_custkey IS NOT NULL OR (SELECT count(*) FROM (SELECT 1 FROM orders WHERE o_totalprice > 200000 LIMIT 1)) = 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 200000 AND o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 200000 AND o_custkey IS NULL)",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
)
add("join_scalar_subquery", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)")
# Aggregation.
add("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
add("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
add("agg_percentile", "SELECT c_mktsegment, round(percentile(c_acctbal, 0.25), 4) AS q FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) AS q FROM customer GROUP BY c_mktsegment")
add("agg_moments", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(corr(c_acctbal, c_custkey), 6) AS r FROM customer GROUP BY c_mktsegment")
add("agg_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
add("agg_arg", "SELECT user_id, max_by(event_type, ts) AS newest, min_by(event_type, ts) AS oldest FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_type, ts) AS newest, arg_min(event_type, ts) AS oldest FROM events GROUP BY user_id")
add("agg_list", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
add("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
# Windows.
add("window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
add("window_top_k", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
add("window_tiles", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS tile, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d FROM customer")
add("window_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
add("window_rows", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
# Order, limit, sets.
add("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("order_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 30")
add("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
# Scalar functions.
add("scalar_strings", "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS s, replace(p_name, 'a', 'b') AS r, lpad(p_brand, 12, '*') AS l, reverse(p_type) AS v FROM part")
add("scalar_regex", "SELECT doc_id, regexp_replace(lower(text), '[^a-z]+', ' ') AS plain FROM documents", "SELECT doc_id, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS plain FROM documents")
add("scalar_dates", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w FROM orders", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, weekofyear(o_orderdate)::INTEGER AS w FROM orders")
add("scalar_json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")
add("scalar_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
add("scalar_url", "SELECT page_id, parse_url(url, 'HOST') AS host FROM pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
# Time windows.
add("time_tumbling", "SELECT w.start AS start, event_type, count(*) AS n FROM (SELECT window(ts, '1 hour') AS w, event_type FROM events) GROUP BY w.start, event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
# Further forms of the above.
add("pipe_syntax", "FROM customer |> WHERE c_acctbal > 0 |> AGGREGATE count(*) AS n GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
add("recursive_counter", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t")
add("join_lateral", "SELECT c_custkey, x.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) x")
add("agg_filter", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0) AS n FROM customer GROUP BY ALL")
add("agg_grouping_id", "SELECT l_returnflag, l_linestatus, grouping_id() AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("agg_kurtosis", "SELECT c_mktsegment, round(kurtosis(c_acctbal), 4) AS k FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, round(kurtosis_pop(c_acctbal), 4) AS k FROM customer GROUP BY c_mktsegment")
add("agg_bools", "SELECT c_mktsegment, bool_and(c_acctbal > 0) AS every, bool_or(c_acctbal > 9000) AS some FROM customer GROUP BY c_mktsegment")
add("agg_copies", "SELECT md5(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
add("window_shares", "SELECT c_custkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
add("window_lead", "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
add("scalar_math", "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS s, round(ln(p_retailprice), 6) AS l, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, power(p_size, 2) AS p, abs(-p_size) AS a FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS s, round(ln(p_retailprice), 6) AS l, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, power(p_size, 2) AS p, abs(-p_size) AS a FROM part")
add("scalar_arrays", "SELECT vec_id, array_max(embedding) AS most, size(embedding) AS n, size(filter(embedding, x -> x > 0.25)) AS large FROM embeddings", "SELECT vec_id, list_max(embedding) AS most, len(embedding)::INTEGER AS n, len(list_filter(embedding, lambda x: x > 0.25))::INTEGER AS large FROM embeddings")
add("scalar_digests", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
add("scalar_calendar", "SELECT o_orderkey, last_day(o_orderdate) AS e, dayofyear(o_orderdate) AS d, o_orderdate + INTERVAL 1 MONTH AS m FROM orders", "SELECT o_orderkey, last_day(o_orderdate) AS e, dayofyear(o_orderdate)::INTEGER AS d, o_orderdate + INTERVAL 1 MONTH AS m FROM orders")
add("scalar_conditions", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS n, greatest(c_acctbal, 0.0D) AS g, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'none' END AS c FROM customer", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS n, greatest(c_acctbal, 0.0::DOUBLE) AS g, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'none' END AS c FROM customer")
