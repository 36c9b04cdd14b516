"""Registered relational queries, each with the SQL that the oracle runs. Where both dialects agree the text is shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starprism import functions as own
from starprism import sources, streaming
from starprism.cube import sqlcompat
from starprism.plans.star import views

# name: (SQL for Spark, SQL for the oracle or None if it is the same)
SHARED: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_qty FROM lineitem", None),
    "select_star": ("SELECT * FROM supplier", None),
    "filter_compare": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'N' AND 10 <= l_quantity", None),
    "filter_in_not_in": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (1, 2)", None),
    "filter_between": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", None),
    "filter_or_tree": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity > 40) OR (l_returnflag = 'R' AND (l_quantity < 5 OR l_discount = 0.1)) OR NOT (l_tax < 0.07)", None),
    "filter_null": ("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 WHERE o_orderkey IS NULL OR c_acctbal IS NULL", None),
    "filter_not_null": ("SELECT count(*) AS n FROM (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey) t WHERE o_orderkey IS NOT NULL", None),
    "filter_case": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_returnflag = 'A' THEN l_quantity WHEN l_returnflag = 'R' THEN 2 * l_quantity ELSE 0 END > 50", None),
    "filter_extract": ("SELECT count(*) AS n, CAST(sum(CASE WHEN EXTRACT(DAY FROM l_shipdate) > 15 THEN 1 ELSE 0 END) AS BIGINT) AS late FROM lineitem WHERE EXTRACT(YEAR FROM l_shipdate) = 1996 AND EXTRACT(MONTH FROM l_shipdate) IN (1, 2, 3)", None),
    "filter_cast": ("SELECT p_partkey FROM part WHERE CAST(p_size AS DOUBLE) / 2 > 20.0", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' OR p_name LIKE 'part#_1%' ESCAPE '#'", None),
    "filter_constant": ("SELECT count(*) AS n FROM nation WHERE 1 < 3 AND NOT (1 <> 1)", None),
    "filter_timestamp": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 12:30:00'", None),
    "select_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "select_without_from": ("SELECT 1 AS one, 'x' AS letter", None),
    "values_rows": ("SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)", None),
    "join_inner_star": ("SELECT p_brand, s_name, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand, s_name", None),
    "join_left_star": ("SELECT p_brand, count(*) AS n, count(p_partkey) AS matched FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY p_brand", None),
    "join_composite": ("SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON b.l_linenumber = a.l_linenumber AND a.l_orderkey = b.l_orderkey", None),
    "join_snowflake": ("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name", None),
    "join_theta": ("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 20 * c_acctbal", None),
    "join_outer_theta": ("SELECT count(*) AS n, count(o_orderkey) AS met FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 20 * c_acctbal", None),
    "join_right": ("SELECT count(*) AS n, count(o_orderkey) AS met FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", None),
    "join_full": ("SELECT count(*) AS n, count(n_nationkey) AS left_met, count(s_suppkey) AS right_met FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey", None),
    "join_cross_small": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_comma": ("SELECT n_name, count(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY n_name", None),
    "join_using": ("SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM orders) a JOIN (SELECT c_custkey AS k FROM customer) b USING (k)", None),
    "join_subquery_topk": ("SELECT l.l_suppkey, round(sum(l.l_extendedprice), 2) AS price FROM lineitem l JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey ORDER BY q DESC, l_suppkey LIMIT 5) t ON l.l_suppkey = t.l_suppkey GROUP BY l.l_suppkey", None),
    "join_semi": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", None),
    "join_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", None),
    "join_anti": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "join_not_in": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10 AND l_partkey IS NOT NULL)", None),
    "agg_sum_count": ("SELECT l_returnflag, round(sum(l_quantity), 2) AS qty, count(*) AS n, count(1) AS ones, count(l_tax) AS taxes FROM lineitem GROUP BY l_returnflag", None),
    "agg_min_max": ("SELECT l_linestatus, min(l_extendedprice) AS least, max(l_extendedprice) AS most, min(l_shipdate) AS first_ship, max(l_orderkey) AS last_order FROM lineitem GROUP BY l_linestatus", None),
    "agg_avg": ("SELECT l_returnflag, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag", None),
    "agg_distinct_exact": ("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", None),
    "agg_distinct_pairs": ("SELECT l_returnflag, count(DISTINCT l_partkey, l_suppkey) AS pairs FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY l_returnflag"),
    "agg_empty_input": ("SELECT count(*) AS n, coalesce(sum(l_quantity), 0) AS zero FROM lineitem WHERE l_quantity < 0", None),
    "agg_having": ("SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 AND sum(l_quantity) > 100", None),
    "agg_nested": ("SELECT n, count(*) AS suppliers, round(avg(q), 4) AS mean_qty FROM (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) t GROUP BY n", None),
    "agg_dim_as_metric": ("SELECT p_brand, max(p_size) AS largest, min(l_suppkey) AS first_supplier FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand", None),
    "group_by_case": ("SELECT CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS bucket, count(*) AS n FROM lineitem GROUP BY CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END", None),
    "group_by_extract": ("SELECT CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS y, CAST(quarter(l_shipdate) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY EXTRACT(YEAR FROM l_shipdate), quarter(l_shipdate)", None),
    "group_by_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "group_by_rollup": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "group_by_grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "sort_ordinal": ("SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, 1", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "order_by_aggregate": ("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 7", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier", None),
    "cte": ("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big, top WHERE n = m", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)", None),
    "correlated_subquery": ("SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)", None),
    "window_rank": ("SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", None),
    "window_frame": ("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before FROM orders", None),
    "window_range": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part", None),
    "fn_string": ("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, substring(p_name, 2, 3) AS part_of, char_length(p_name) AS len, p_brand || '-' || p_type AS joined, trim(BOTH 'x' FROM 'xx' || p_brand || 'x') AS trimmed, ltrim('  a') AS lt, rtrim('a  ') AS rt, position('a' IN p_name) AS pos FROM part", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, substring(p_name, 2, 3) AS part_of, CAST(length(p_name) AS INTEGER) AS len, p_brand || '-' || p_type AS joined, trim('xx' || p_brand || 'x', 'x') AS trimmed, ltrim('  a') AS lt, rtrim('a  ') AS rt, CAST(strpos(p_name, 'a') AS INTEGER) AS pos FROM part"),
    "fn_overlay": ("SELECT p_partkey, overlay(p_brand PLACING '##' FROM 2 FOR 3) AS changed FROM part", "SELECT p_partkey, substring(p_brand, 1, 1) || '##' || substring(p_brand, 5) AS changed FROM part"),
    "fn_math": ("SELECT p_partkey, round(exp(p_size / 50.0D), 6) AS e, power(p_size, 2) AS sq, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, p_size % 7 AS m, abs(-p_size) AS a, p_size div 4 AS d, least(p_size, 10) AS lo, greatest(p_size, 10) AS hi FROM part", "SELECT p_partkey, round(exp(p_size / 50.0), 6) AS e, CAST(power(p_size, 2) AS DOUBLE) AS sq, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, p_size % 7 AS m, abs(-p_size) AS a, CAST(p_size // 4 AS BIGINT) AS d, least(p_size, 10) AS lo, greatest(p_size, 10) AS hi FROM part"),
    "fn_date": ("SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day, CAST(make_date(2000, 2, 29) AS VARCHAR(10)) AS leap FROM orders", None),
    "fn_cast": ("SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(p_retailprice AS BIGINT) AS whole, CAST(p_size > 25 AS STRING) AS flag, CAST('12.5' AS DOUBLE) AS num, CAST(CAST(p_retailprice AS DECIMAL(12,1)) AS DOUBLE) AS dec1 FROM part WHERE p_retailprice = floor(p_retailprice) OR p_size < 5", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size > 25 AS VARCHAR) AS flag, CAST('12.5' AS DOUBLE) AS num, CAST(CAST(p_retailprice AS DECIMAL(12,1)) AS DOUBLE) AS dec1 FROM part WHERE p_retailprice = floor(p_retailprice) OR p_size < 5"),
    "fn_logic": ("SELECT c_custkey, (c_acctbal > 0) IS TRUE AS pos, (c_acctbal > 0) IS NOT FALSE AS notneg, NOT (c_nationkey = 3) AS other FROM customer", None),
    "fn_array_map": ("SELECT vec_id, element_at(embedding, 1) AS first_x, slice(embedding, 2, 2)[0] AS second_x, size(embedding) AS dims FROM embeddings", "SELECT vec_id, embedding[1] AS first_x, embedding[2:3][1] AS second_x, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings"),
    "unnest": ("SELECT vec_id, pos, x FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 3)) t AS pos, x", "SELECT vec_id, CAST(pos AS INTEGER) AS pos, embedding[pos + 1] AS x FROM embeddings, range(3) r(pos)"),
    "interval_text": ("SELECT o_orderkey, CAST(make_ym_interval(0, CAST(o_orderkey % 30 AS INT)) AS STRING) AS ym, CAST(make_dt_interval(1, CAST(o_orderkey % 24 AS INT), 5, 0) AS STRING) AS dt, CAST(CAST(o_orderdate + INTERVAL '1' DAY AS DATE) AS STRING) AS next_day FROM orders", "SELECT o_orderkey, 'INTERVAL ' || chr(39) || CAST((o_orderkey % 30) // 12 AS VARCHAR) || '-' || CAST((o_orderkey % 30) % 12 AS VARCHAR) || chr(39) || ' YEAR TO MONTH' AS ym, 'INTERVAL ' || chr(39) || '1 ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05:00' || chr(39) || ' DAY TO SECOND' AS dt, CAST(CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS next_day FROM orders"),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier", None),
    "filter_in_long": (f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({', '.join(map(str, range(0, 6000, 3)))})", None),
    "fn_cast_kinds": ("SELECT p_partkey, CAST(CAST(p_size AS TINYINT) AS INT) AS b, CAST(CAST(p_size AS SMALLINT) AS INT) AS s, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS f, CAST(p_size - 1 AS BOOLEAN) AS t, CAST('true' AS BOOLEAN) AS y FROM part", None),
    "fn_least_nulls": ("SELECT p_partkey, least(nullif(p_size, 10), 20) AS lo, greatest(nullif(p_size, 10), 5) AS hi FROM part", None),
    "fn_map": ("SELECT p_partkey, element_at(map('size', p_size, 'two', 2), 'size') AS size, map('a', p_brand)['a'] AS brand, size(map_keys(map(p_partkey, 1))) AS n FROM part", "SELECT p_partkey, p_size AS size, p_brand AS brand, CAST(1 AS INTEGER) AS n FROM part"),
    "fn_timestamp_text": ("SELECT o_orderkey, CAST(o_orderdate AS STRING) AS shown, CAST(CAST(o_orderdate AS STRING) AS TIMESTAMP) = o_orderdate AS back, date_format(o_orderdate, 'HH:mm:ss') AS clock FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS shown, CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) = o_orderdate AS back, strftime(o_orderdate, '%H:%M:%S') AS clock FROM orders"),
    "fn_current": ("SELECT CURRENT_DATE >= DATE '2024-01-01' AS day, CURRENT_TIMESTAMP >= TIMESTAMP '2024-01-01 00:00:00' AS moment, localtimestamp() >= TIMESTAMP_NTZ '2024-01-01 00:00:00' AS local, datediff(CURRENT_DATE, CAST(CURRENT_TIMESTAMP AS DATE)) AS apart", "SELECT CURRENT_DATE >= DATE '2024-01-01' AS day, TRUE AS moment, TRUE AS local, CAST(0 AS INTEGER) AS apart"),
    "healed_sql": ("SELECT TOP 5 {fn upper(p_brand)} AS brand, SUM(1) AS n FROM part WHERE p_brand SIMILAR TO '%(1|2)_' GROUP BY p_brand ORDER BY 2 DESC, 1", "SELECT upper(p_brand) AS brand, count(1) AS n FROM part WHERE regexp_full_match(p_brand, '.*(1|2).') GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 5"),
}


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return sqlcompat.run(spark, sqlcompat.heal(text))

    return run


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def param_binding(spark, sf_dir):
    views(spark, sf_dir)
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = ? AND o_totalprice > ?", args=["1-URGENT", 1000.0])


def fn_compat(spark, sf_dir):
    d = _read(spark, sf_dir, "orders")
    return d.select("o_orderkey", own.quarter_by_fours(F.col("o_orderdate")).alias("q4"), own.initcap_words(F.concat(F.lower("o_orderpriority"), F.lit("-abc d2e"))).alias("cap"), own.round_to(F.col("o_totalprice"), F.lit(100.0)).alias("hundreds"), own.truncating_div(F.col("o_orderkey"), F.lit(-7)).alias("div7"))


def distinct_values(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_returnflag").distinct()


def events_tumbling(spark, sf_dir):
    return streaming.windowed(_read(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", value="value").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def events_sessions(spark, sf_dir):
    return streaming.sessions(_read(spark, sf_dir, "events"), "ts", "user_id", "30 minutes").select("user_id", "session_start", "n")


def window_top_per_group(spark, sf_dir):
    order = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return _read(spark, sf_dir, "part").withColumn("rk", F.row_number().over(order)).where("rk <= 3").select("p_brand", "p_partkey", "rk")


def fn_decimal_div(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", F.floor(own.decimal_div(F.col("l_extendedprice"), F.col("l_quantity")) * 1000 + F.lit(0.003)).cast("long").alias("thousandths"), own.decimal_div(F.col("l_tax"), F.lit(0)).isNull().alias("none"))


def fn_varchar(spark, sf_dir):
    d = _read(spark, sf_dir, "part")
    return d.select("p_partkey", own.varchar(F.col("p_type"), 3).alias("cut"), own.varchar(F.col("p_size"), 1).alias("digit"))


def near(estimate: str, exact: str, sigma: float):
    """Whether a sketch's estimate is within three standard errors of the exact count."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(3 * sigma * F.col(exact), F.lit(1.0))


def hll_one_shot(spark, sf_dir):
    """Distinct counts by sketch in one pass, held against exact ones."""
    d = _read(spark, sf_dir, "lineitem")
    both = d.groupBy("l_returnflag").agg(own.sketch_distinct(F.col("l_partkey"), 14).alias("parts"), F.approx_count_distinct("l_suppkey", 0.02).alias("suppliers"), F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))
    return both.select("l_returnflag", "n_parts", "n_suppliers", near("parts", "n_parts", 1.04 / 2**7).alias("parts_near"), near("suppliers", "n_suppliers", 0.02).alias("suppliers_near"))


def column_cardinality(spark, sf_dir):
    """Approximate cardinality of each column, held against exact ones."""
    from starprism.cube.engine import cardinality

    d = _read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    exact = d.agg(*[F.count_distinct(c).alias(c) for c in d.columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_exact")) for c in d.columns])).alias("x")).select("x.*")
    return cardinality(d).join(exact, "column_name").select("column_name", "n_exact", near("n_distinct", "n_exact", 0.02).alias("near"))


def csv_round_trip(spark, sf_dir):
    """Nation written by the CSV writer and read by the delimited reader."""
    from starprism.plans.star import _root

    path = _root(spark) + "/nation-csv"
    nation = _read(spark, sf_dir, "nation")
    nation.write.option("sep", "|").csv(path)
    return sources.read_delimited(spark, path, nation.schema)


FRAMES = (param_binding, fn_compat, distinct_values, events_tumbling, events_sessions, window_top_per_group, fn_decimal_div, fn_varchar, hll_one_shot, column_cardinality, csv_round_trip)
FRAME_SQL = {
    "param_binding": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000.0",
    "fn_compat": "SELECT o_orderkey, CAST(month(o_orderdate) // 4 + 1 AS INTEGER) AS q4, array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority) || '-abc d2e', '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS cap, floor(o_totalprice / 100.0) * 100.0 AS hundreds, CAST(trunc(o_orderkey / -7) AS BIGINT) AS div7 FROM orders",
    "distinct_values": "SELECT DISTINCT l_returnflag FROM lineitem",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
    "window_top_per_group": "SELECT p_brand, p_partkey, CAST(rk AS INTEGER) AS rk FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part) WHERE rk <= 3",
    "csv_round_trip": "SELECT * FROM nation",
    "fn_decimal_div": "SELECT l_orderkey, l_linenumber, CAST(floor(CAST(CAST(l_extendedprice AS DECIMAL(19,4)) AS DOUBLE) / CAST(CAST(l_quantity AS DECIMAL(19,4)) AS DOUBLE) * 1000 + 0.003) AS BIGINT) AS thousandths, TRUE AS none FROM lineitem",
    "fn_varchar": "SELECT p_partkey, substring(p_type, 1, 3) AS cut, substring(CAST(p_size AS VARCHAR), 1, 1) AS digit FROM part",
    "hll_one_shot": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, TRUE AS parts_near, TRUE AS suppliers_near FROM lineitem GROUP BY l_returnflag",
    "column_cardinality": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_exact, TRUE AS near FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
}

QUERIES = {name: _sql(text) for name, (text, _) in SHARED.items()} | {f.__name__: f for f in FRAMES}
ORACLES = {name: other or text for name, (text, other) in SHARED.items()} | FRAME_SQL
