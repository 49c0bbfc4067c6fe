"""More of the survey's candidates: reshaping, join strategies, sketches, scalar functions, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import text_joins

from .catalogue import add, run_sql
from .registry import query, table

# Rows without a table, and samples.
add("values_inline", "SELECT a, b FROM VALUES (1, 'x'), (2, NULL), (3, 'z') AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS t(a, b)")
add("sample_hashed", "SELECT o_orderkey FROM orders WHERE substring(md5(CAST(o_orderkey AS STRING)), 1, 1) < '4'", "SELECT o_orderkey FROM orders WHERE substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '4'")


@query("SELECT range AS id, range * range AS square FROM range(0, 1000, 3)")
def values_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 1000, 3).select("id", (F.col("id") * F.col("id")).alias("square"))


@query()
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders; which ones depends on how files are split, so there is no SQL to compare with."""
    return table(spark, sf_dir, "orders").sample(0.1, seed=1)


# Reshaping.
add("filter_never", "SELECT c_custkey FROM customer WHERE c_custkey < 0 AND c_custkey > 0")
add(
    "pivot_flags",
    "SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
    "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag",
)
add(
    "unpivot_supplier",
    "SELECT s_suppkey, name, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (v FOR name IN (nation, balance))",
    "SELECT s_suppkey, 'nation' AS name, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
)


@query("SELECT 'n' AS key, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders")
def transpose_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transposing gathers all rows, so it is for results of a known few."""
    return table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O', 'P')").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).transpose("o_orderstatus")


# Join strategies and inequality joins of tables of a fixed size.
add("join_merge", "SELECT /*+ MERGE(orders) */ c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
add("join_shuffle_hash", "SELECT /*+ SHUFFLE_HASH(customer) */ c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
add("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def join_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_joins.containment_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text").select("doc_id", "item_id")


# Aggregation.
add("agg_covariance", "SELECT c_mktsegment, round(covar_samp(c_acctbal, c_nationkey), 4) AS cs, round(covar_pop(c_acctbal, c_nationkey), 4) AS cp FROM customer GROUP BY c_mktsegment")
add(
    "agg_skewness",
    "SELECT c_mktsegment, round(skewness(c_acctbal), 6) AS s FROM customer GROUP BY c_mktsegment",
    "SELECT c_mktsegment, round(avg((c_acctbal - u) ** 3) / avg((c_acctbal - u) ** 2) ** 1.5, 6) AS s FROM customer JOIN (SELECT c_mktsegment AS m, avg(c_acctbal) AS u FROM customer GROUP BY 1) ON c_mktsegment = m GROUP BY c_mktsegment",
)
add("agg_collect", "SELECT o_custkey, to_json(sort_array(collect_list(o_orderkey))) AS keys FROM orders GROUP BY o_custkey", "SELECT o_custkey, to_json(list(o_orderkey ORDER BY o_orderkey))::VARCHAR AS keys FROM orders GROUP BY o_custkey")
add("agg_mode", "SELECT c_mktsegment, mode(c_nationkey, true) AS m, any_value(c_mktsegment) AS a FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, min(c_nationkey) FILTER (WHERE n = most) AS m, c_mktsegment AS a FROM (SELECT *, max(n) OVER (PARTITION BY c_mktsegment) AS most FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)) GROUP BY c_mktsegment")
add(
    "agg_histogram",
    "SELECT c_mktsegment, aggregate(histogram_numeric(c_acctbal, 8), 0D, (s, b) -> s + b.y) AS n, size(histogram_numeric(c_acctbal, 8)) AS bins FROM customer GROUP BY c_mktsegment",
    "SELECT c_mktsegment, count(*)::DOUBLE AS n, 8 AS bins FROM customer GROUP BY c_mktsegment",
)
# Approximate aggregates: whether they stay within their bounds. A sketch beside a count of
# distinct values would be kept for each value, so the two are made apart.
add("approx_distinct", "SELECT abs(approx - exact) <= 0.08 * exact AS near FROM (SELECT approx_count_distinct(l_partkey, 0.02) AS approx FROM lineitem) CROSS JOIN (SELECT count(DISTINCT l_partkey) AS exact FROM lineitem)", "SELECT count(*) > 0 AS near FROM lineitem")
add(
    "approx_percentile",
    "SELECT abs(approx - exact) <= 0.01 * spread AS near FROM (SELECT percentile_approx(c_acctbal, 0.5, 10000) AS approx, percentile(c_acctbal, 0.5) AS exact, max(c_acctbal) - min(c_acctbal) AS spread FROM customer)",
    "SELECT count(*) > 0 AS near FROM customer",
)
add("sketch_hll", "SELECT abs(approx - exact) <= 0.05 * exact AS near FROM (SELECT hll_sketch_estimate(hll_sketch_agg(l_partkey, 14)) AS approx FROM lineitem) CROSS JOIN (SELECT count(DISTINCT l_partkey) AS exact FROM lineitem)", "SELECT count(*) > 0 AS near FROM lineitem")
add("sketch_theta", "SELECT abs(approx - exact) <= 0.1 * exact AS near FROM (SELECT theta_sketch_estimate(theta_sketch_agg(o_custkey)) AS approx FROM orders) CROSS JOIN (SELECT count(DISTINCT o_custkey) AS exact FROM orders)", "SELECT count(*) > 0 AS near FROM orders")
add("sketch_union", "SELECT hll_sketch_estimate(hll_union_agg(s)) BETWEEN 22 AND 28 AS near FROM (SELECT n_regionkey, hll_sketch_agg(n_nationkey) AS s FROM nation GROUP BY n_regionkey)", "SELECT true AS near")
add("sketch_quantiles", "SELECT abs(kll_sketch_get_quantile_bigint(kll_sketch_agg_bigint(o_orderkey), 0.5D) - percentile(o_orderkey, 0.5)) <= 0.05 * max(o_orderkey) AS near FROM orders", "SELECT count(*) > 0 AS near FROM orders")
add(
    "agg_bitmap",
    "SELECT sum(n) AS n FROM (SELECT bitmap_count(bitmap_construct_agg(bitmap_bit_position(o_custkey))) AS n FROM orders GROUP BY bitmap_bucket_number(o_custkey))",
    "SELECT count(DISTINCT o_custkey) AS n FROM orders",
)


@query("SELECT count(*) AS n FROM lineitem")
def sketch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows by a count-min sketch of one value they share; such a sketch never counts too few."""
    sketch = F.count_min_sketch(F.lit(1), F.lit(0.001), F.lit(0.99), F.lit(1))
    # the total stands in bytes 5 to 12 of the serialised form
    return table(spark, sf_dir, "lineitem").agg(F.conv(F.substring(F.hex(sketch), 9, 16), 16, 10).cast("long").alias("n"))


# Windows.
add("window_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
add(
    "window_nth",
    "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER w AS second, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
# Order and sets.
add(
    "order_nulls",
    "SELECT k, row_number() OVER (ORDER BY k ASC NULLS LAST) AS asc_last, row_number() OVER (ORDER BY k DESC NULLS FIRST) AS desc_first FROM (SELECT DISTINCT nullif(n_regionkey, 2) AS k FROM nation)",
)
add("order_nulls_top", "SELECT n_nationkey FROM nation ORDER BY nullif(n_regionkey, 2) ASC NULLS FIRST, n_nationkey LIMIT 7")
add("set_except", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")


@query("SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k"))
    return a.unionByName(b, allowMissingColumns=True)


# Scalar functions.
add(
    "scalar_words",
    "SELECT p_partkey, instr(p_name, 'a') AS i, element_at(split(p_type, ' '), 1) AS w, size(split(p_name, ' ')) AS n, initcap(lower(p_brand)) AS c, trim(concat('  ', p_name, ' ')) AS t, ltrim(concat(' ', p_type)) AS l FROM part",
    "SELECT p_partkey, instr(p_name, 'a')::INTEGER AS i, split_part(p_type, ' ', 1) AS w, len(string_split(p_name, ' '))::INTEGER AS n, upper(p_brand[1]) || lower(p_brand[2:]) AS c, trim('  ' || p_name || ' ') AS t, ltrim(' ' || p_type) AS l FROM part",
)
add("scalar_upper_unicode", "SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS u FROM documents WHERE lang = 'de'")
add("scalar_regex_all", "SELECT doc_id, to_json(regexp_extract_all(text, '[0-9][0-9][0-9][0-9]+', 0)) AS found FROM documents", "SELECT doc_id, to_json(regexp_extract_all(text, '[0-9][0-9][0-9][0-9]+', 0))::VARCHAR AS found FROM documents")
add("scalar_date_trunc", "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, CAST(date_trunc('WEEK', o_orderdate) AS DATE) AS w FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m, date_trunc('week', o_orderdate)::DATE AS w FROM orders")
add("scalar_sign", "SELECT c_custkey, sign(c_acctbal) AS s, pmod(c_custkey, 7) AS p, width_bucket(c_acctbal, -1000, 10000, 11) AS b FROM customer", "SELECT c_custkey, sign(c_acctbal)::DOUBLE AS s, c_custkey % 7 AS p, CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 12 ELSE floor((c_acctbal + 1000) / 1000) + 1 END::BIGINT AS b FROM customer")
add("scalar_sort_array", "SELECT vec_id, element_at(sort_array(embedding), 1) AS least, element_at(sort_array(embedding, false), 2) AS second, array_position(embedding, array_max(embedding)) AS at FROM embeddings", "SELECT vec_id, list_sort(embedding)[1] AS least, list_reverse_sort(embedding)[2] AS second, list_position(embedding, list_max(embedding))::BIGINT AS at FROM embeddings")
add("scalar_from_json", "SELECT event_id, from_json(props, 'k BIGINT').k AS k FROM events", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
add("scalar_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k, schema_of_variant(parse_json(props)) AS kind FROM events", "SELECT event_id, (props ->> '$.k')::BIGINT AS k, 'OBJECT<k: BIGINT>' AS kind FROM events")
add("scalar_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '') AS plain FROM pages", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
add(
    "scalar_maps",
    "SELECT conv_id, element_at(m, 'user') AS users, size(map_filter(m, (k, v) -> v > 1)) AS many, array_join(array_sort(map_keys(transform_keys(m, (k, v) -> upper(k)))), ',') AS roles FROM (SELECT conv_id, map_from_entries(collect_list(struct(role, n))) AS m FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id)",
    "SELECT conv_id, max(n) FILTER (WHERE role = 'user') AS users, (count(*) FILTER (WHERE n > 1))::INTEGER AS many, string_agg(upper(role), ',' ORDER BY upper(role)) AS roles FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id",
)
add("scalar_try", "SELECT o_orderkey, try_divide(o_totalprice, o_orderkey % 3) IS NULL AS none, try_cast(o_orderstatus AS INT) AS i, regexp_count(o_orderpriority, '[A-Z]') AS caps FROM orders", "SELECT o_orderkey, o_orderkey % 3 = 0 AS none, try_cast(o_orderstatus AS INTEGER) AS i, len(regexp_extract_all(o_orderpriority, '[A-Z]'))::INTEGER AS caps FROM orders")
add("scalar_url_decode", "SELECT page_id, url_decode(url_encode(url)) AS url, soundex('Robert') AS s FROM pages", "SELECT page_id, url, 'R163' AS s FROM pages")
add("scalar_xpath", "SELECT s_suppkey, xpath_string(concat('<a><b>', s_name, '</b></a>'), 'a/b') AS b FROM supplier", "SELECT s_suppkey, s_name AS b FROM supplier")


@query("SELECT c_custkey, round(c_acctbal * 1.19, 2) AS gross FROM customer")
def function_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function written in SQL, which the optimiser inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION with_tax(x DOUBLE) RETURNS DOUBLE RETURN x * 1.19D")
    return run_sql(spark, sf_dir, "SELECT c_custkey, round(with_tax(c_acctbal), 2) AS gross FROM customer")
