"""Queries that are one SQL text: (tables, Spark SQL, DuckDB SQL where it differs)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lumenmill.sources.tables import TABLES, register

#: name -> (Spark SQL, DuckDB SQL or None if the text is the same)
QUERIES: dict[str, tuple[str, str | None]] = {}


def add(name: str, text: str, duck: str | None = None) -> None:
    """Register a query."""
    QUERIES[name] = (text.strip(), duck.strip() if duck else None)


def tables_in(text: str) -> tuple[str, ...]:
    """Driver tables that a text names."""
    words = set(re.findall(r"\w+", text))
    return tuple(t for t in TABLES if t in words)


def runner(text: str):
    """A query function for a SQL text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tables_in(text))
        return spark.sql(text)

    return run


# flagship: revenue by nation and order priority
add("revenue_by_nation", """
SELECT n_name, o_orderpriority, count(*) AS n_items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= timestamp '1995-01-01' GROUP BY n_name, o_orderpriority HAVING count(*) > 10""")

# projection, filter, predicates
add("project_star", "SELECT * FROM nation")
add("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS neg_qty FROM lineitem WHERE l_quantity > 45")
add("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND o_orderpriority < '3'")
add("filter_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 10, 15)")
add("filter_not_in", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')")
add("filter_between", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 10")
add("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE 'z_%'")
add("filter_ilike", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'CUSTOMER%1_'")
add("filter_similar", "SELECT p_partkey, p_brand FROM part WHERE p_brand RLIKE '^(Brand#(1|2)[0-9])$'", "SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2)[0-9]')")
add("filter_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL AND o_orderpriority IS NOT NULL")
add("filter_logic", "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND NOT c_nationkey = 3")
add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE 'other' END AS state FROM orders")
add("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class FROM customer")
add("concat_op", "SELECT s_suppkey, s_name || '/' || CAST(s_nationkey AS STRING) AS tag FROM supplier")
add("literals", "SELECT 1 AS one, 2.5 AS half, 'x' AS letter, TRUE AS yes, CAST(NULL AS INT) AS nothing", "SELECT 1 AS one, 2.5 AS half, 'x' AS letter, TRUE AS yes, CAST(NULL AS INT) AS nothing")
add("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
add("exists_subquery", "SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R')")
add("not_exists_subquery", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
add("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders)")
add("correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
add("derived_table", "SELECT seg, max(n) AS top FROM (SELECT c_mktsegment AS seg, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) t GROUP BY seg")

# joins
add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
add("join_theta", "SELECT a.p_partkey AS a, b.s_suppkey AS b FROM part a JOIN supplier b ON a.p_retailprice < b.s_acctbal AND a.p_size = b.s_nationkey WHERE a.p_size < 5")
add("join_multi_cond", "SELECT count(*) AS n, round(sum(l1.l_quantity), 2) AS q FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l1.l_partkey = l2.l_partkey AND l1.l_linenumber <= l2.l_linenumber")
add("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
add("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
add("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey < 12")
add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
add("join_comma", "SELECT n_name, count(*) AS n FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND o_orderstatus = 'O' GROUP BY n_name")
add("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("join_using", "SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM orders) JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem) USING (o_orderkey) GROUP BY o_orderkey HAVING count(*) > 6")
add("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
add("join_anti", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey", "SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey")
add("join_lateral", "SELECT n_name, s FROM nation, LATERAL (SELECT count(*) AS s FROM supplier WHERE s_nationkey = n_nationkey)")
# rows of a key are counted before they meet: its pairs are the product of the counts
add("join_null_safe", "SELECT coalesce(sum(a.n * b.n), 0) AS n FROM (SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT nullif(s_nationkey, 3) AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k <=> b.k", "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
add("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < timestamp '1997-03-15' AND l_shipdate > timestamp '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")

# aggregation
add("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
add("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
add("agg_count", "SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS not_final FROM orders")
add("agg_sum_avg", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey")
add("agg_min_max", "SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, min(p_name) AS first_name, max(p_type) AS last_type FROM part GROUP BY p_brand")
add("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
add("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
add("agg_expr", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_total FROM orders GROUP BY o_orderpriority")
add("agg_having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15")
add("agg_having", "SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 15000 AND min(l_discount) = 0")
add("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS top FROM orders WHERE o_totalprice < 0")
add("agg_null_group", "SELECT nullif(c_nationkey, 7) AS k, count(*) AS n FROM customer GROUP BY nullif(c_nationkey, 7)")
add("agg_first_any", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY o_custkey")
add("agg_array", "SELECT n_regionkey, array_join(array_sort(collect_list(n_nationkey)), '-') AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), '-') AS ks FROM nation GROUP BY n_regionkey")
add("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 150000) AS big FROM orders GROUP BY o_orderpriority")
add("rollup", "SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
add("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id() AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
add("grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")

# window functions
W = "OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"
WR = "OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add("win_row_number", f"SELECT c_custkey, CAST(row_number() {W} AS BIGINT) AS rn FROM customer")
add("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr FROM part")
add("win_ntile", f"SELECT c_custkey, CAST(ntile(4) {W} AS BIGINT) AS bucket FROM customer")
add("win_ntile_compat", "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) * 4 / count(*) OVER (PARTITION BY o_orderstatus)) + 1 AS BIGINT) AS bucket FROM orders")
add("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, CAST(-1.0 AS DOUBLE)) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
add("win_first_last", f"SELECT c_custkey, first_value(c_custkey) {WR} AS f, last_value(c_custkey) {WR} AS l FROM customer")
add("win_nth", f"SELECT c_custkey, nth_value(c_custkey, 3) {WR} AS third FROM customer")
add("win_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 6) AS cd FROM part")
add("win_percentile_cont", "SELECT DISTINCT c_mktsegment, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS med FROM customer", "SELECT DISTINCT c_mktsegment, round(quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_mktsegment), 4) AS med FROM customer")
add("agg_percentile_disc", "SELECT c_mktsegment, percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal) AS q FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, quantile_disc(c_acctbal, 0.25) AS q FROM customer GROUP BY c_mktsegment")
add("win_sum_running", f"SELECT c_custkey, round(sum(c_acctbal) {WR}, 2) AS run FROM customer")
add("win_avg_moving", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ma FROM orders")
add("win_min_max_frame", "SELECT o_orderkey, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
add("win_count_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM orders")
add("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part")
add("win_share", "SELECT s_suppkey, round(s_acctbal / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier")

# sort, limit, distinct
add("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("order_nulls", "SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM customer ORDER BY k ASC NULLS LAST, c_custkey DESC LIMIT 50")
add("order_nulls_default", "SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM customer ORDER BY k, c_custkey LIMIT 30", "SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM customer ORDER BY k NULLS FIRST, c_custkey LIMIT 30")
add("limit_offset", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 25")
add("top_per_group", f"SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() {W} AS rn FROM customer) WHERE rn <= 3")
add("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# set operations, CTE, recursion, series
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_all", "SELECT 'c' AS src, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier")
add("intersect_set", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
add("except_set", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
add("cte_alias", "WITH t(seg, n) AS (SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment) SELECT seg, n FROM t WHERE n > 10")
add("recursive_series", "WITH RECURSIVE f(n, fact) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, fact * (n + 1) FROM f WHERE n < 15) SELECT n, fact FROM f")
add("generate_series", "SELECT v FROM (SELECT explode(sequence(1, 100, 7)) AS v)", "SELECT CAST(v AS INT) AS v FROM generate_series(1, 100, 7) t(v)")
add("pivot_sql", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority")
add("unpivot_sql", "SELECT s_suppkey, name, val FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, nullif(s_acctbal, 0) AS bal FROM supplier) UNPIVOT (val FOR name IN (nation, bal))", "SELECT s_suppkey, 'nation' AS name, CAST(s_nationkey AS DOUBLE) AS val FROM supplier UNION ALL SELECT s_suppkey, 'bal', s_acctbal FROM supplier WHERE s_acctbal <> 0")

# time series and streaming windows over the stored events
add("win_tumbling", "SELECT date_format(w.start, 'yyyy-MM-dd HH:mm:ss') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT window(ts, '1 hour') AS w, event_type, value FROM events) GROUP BY w, event_type", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type")
add("win_hopping", "SELECT date_format(w.start, 'yyyy-MM-dd HH:mm:ss') AS start, count(*) AS n FROM (SELECT window(ts, '2 hours', '1 hour') AS w FROM events) GROUP BY w", "SELECT strftime(b - o * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, unnest([0, 1]) AS o FROM events) GROUP BY b - o * INTERVAL 1 HOUR")
# milliseconds rounded, halves away from 0. A frame of fixed length is a running sum in cells of that length: an event counts
# from its time on, is carried into the next cell from the start, and leaves it when the frame does
add("win_sliding", """
WITH e AS (SELECT event_id, event_type, (us DIV 500 + IF(us < 0, -1, 1)) DIV 2 AS ms FROM (SELECT event_id, event_type, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events)),
c AS (SELECT event_id, event_type, ms, ms - pmod(ms, 3600000) AS cell FROM e),
s AS (SELECT event_id, event_type, stack(3, cell, ms, 1, true, cell + 3600000, cell + 3600000, 1, false, cell + 3600000, ms + 3600000, -1, false) AS (cell, at, step, own) FROM c)
SELECT event_id, n FROM (
    SELECT event_id, own, sum(step) OVER (PARTITION BY event_type, cell ORDER BY at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM s
) WHERE own""", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n FROM events")
add("win_session", "SELECT user_id, unix_micros(CAST(w.start AS TIMESTAMP)) AS start_us, count(*) AS n FROM (SELECT session_window(ts, '1799999 milliseconds') AS w, user_id FROM events) GROUP BY user_id, w", "WITH g AS (SELECT *, sum(CASE WHEN ts - prev < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, s")
add("json_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'click'", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'click'")


def queries() -> dict:
    """Name to query function."""
    return {name: runner(text) for name, (text, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: duck or text.replace("AS STRING", "AS VARCHAR") for name, (text, duck) in QUERIES.items()}
