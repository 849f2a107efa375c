"""Queries that apply the engine's own operators to the driver's tables, each with SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.documents import compiler
from lumenmill.functions import core, mssql, mysql, numeric, oracle, postgres
from lumenmill.operators import columnar, dml, fulltext, olap, relational, spatial, timeseries
from lumenmill.plans import dialects
from lumenmill.session import Engine
from lumenmill.sources.tables import read_table
from lumenmill.streaming import engine as stream_engine
from lumenmill.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- limiting ------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_on(spark, d):
    return relational.distinct_on(read_table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER () AS n FROM part) WHERE r <= ceil(n * 5 / 100.0)")
def top_percent(spark, d):
    return relational.top(read_table(spark, d, "part").select("p_partkey", "p_retailprice"), 5, [F.desc("p_retailprice"), F.asc("p_partkey")], percent=True).select("p_partkey")


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def top_ties(spark, d):
    return relational.top(read_table(spark, d, "part").select("p_partkey", "p_size"), 10, [F.desc("p_size")], ties=True)


@query("SELECT * FROM generate_series(10, 50, 5) t(generate_series)")
def series(spark, d):
    return relational.generate_series(spark, 10, 50, 5)


# --- olap ----------------------------------------------------------------------------------


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_type), ())")
def grouping_sets_api(spark, d):
    return olap.grouping_sets(read_table(spark, d, "part"), [("p_brand", "p_type"), ("p_type",), ()], [F.count(F.lit(1)).alias("n")]).select("p_brand", "p_type", "n")


@query("SELECT c_nationkey, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 2) AS b, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 2) AS m FROM customer GROUP BY c_nationkey")
def pivot_sum(spark, d):
    out = olap.pivot(read_table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY"], "SUM", "c_acctbal")
    return out.select("c_nationkey", F.round("BUILDING", 2).alias("b"), F.round("MACHINERY", 2).alias("m"))


@query("SELECT c_custkey, 'bal' AS name, c_acctbal AS val FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'nat', c_nationkey::DOUBLE FROM customer")
def unpivot_nulls(spark, d):
    x = read_table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").cast("double").alias("nat"))
    return olap.unpivot(x, ["c_custkey"], ["bal", "nat"], "name", "val")


_TREE = """WITH RECURSIVE t AS (SELECT n_nationkey, 1 AS level, [n_nationkey] AS path FROM nation WHERE {start} UNION ALL
SELECT n.n_nationkey, t.level + 1, list_append(t.path, n.n_nationkey) FROM nation n JOIN t ON n.n_regionkey = t.n_nationkey WHERE NOT list_contains(t.path, n.n_nationkey))
SELECT n_nationkey, level::BIGINT AS level FROM t"""


@query(_TREE.format(start="n_nationkey < 3"))
def connect_by(spark, d):
    return olap.connect_by(read_table(spark, d, "nation"), "n_nationkey", "n_regionkey", F.col("n_nationkey") < 3).select("n_nationkey", F.col("level").cast("long").alias("level"))


@query(_TREE.format(start="n_nationkey = 2"))
def connect_by_sql(spark, d):
    read_table(spark, d, "nation").createOrReplaceTempView("nation")
    text = "SELECT n_nationkey, CAST(LEVEL AS BIGINT) AS level FROM nation START WITH n_nationkey = 2 CONNECT BY PRIOR n_nationkey = n_regionkey"
    return spark.sql(dialects.rewrite(text, "oracle"))


@query("WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 1 UNION SELECT n.n_nationkey FROM nation n JOIN r ON n.n_regionkey = r.k) SELECT k FROM r")
def recursive_set(spark, d):
    n = read_table(spark, d, "nation")
    step = lambda last: n.join(last, n["n_regionkey"] == last["k"]).select(F.col("n_nationkey").alias("k"))
    return olap.recursive_fixpoint(n.where("n_nationkey = 1").select(F.col("n_nationkey").alias("k")), step)


# --- time series ---------------------------------------------------------------------------


@query("""SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS b, event_type, count(*) AS n, round(sum(value), 4) AS s, min(value) AS lo,
arg_min(value, (ts, event_id)) AS f, arg_max(value, (ts, event_id)) AS l FROM events GROUP BY time_bucket(INTERVAL 15 MINUTE, ts), event_type""")
def time_bucket(spark, d):
    x = timeseries.time_bucket(read_table(spark, d, "events"), "15m", "value", keys=["event_type"], order="event_id")
    return x.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("b"), "event_type", "n", F.round("sum", 4).alias("s"), F.col("min").alias("lo"), F.col("first").alias("f"), F.col("last").alias("l"))


@query("""WITH b AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 6 HOUR)) AS bucket FROM b GROUP BY user_id)
SELECT g.user_id, epoch_ms(g.bucket) AS bucket_ms, last_value(b.n IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.bucket ROWS UNBOUNDED PRECEDING) AS n
FROM g LEFT JOIN b USING (user_id, bucket)""")
def gap_fill(spark, d):
    b = timeseries.time_bucket(read_table(spark, d, "events"), "6h", "value", keys=["user_id"]).select("bucket", "user_id", "n")
    return timeseries.gap_fill(b, "6h", ["user_id"], ["n"]).select("user_id", F.unix_millis("bucket").alias("bucket_ms"), "n")


@query("SELECT event_id FROM events WHERE ts >= timestamp '2024-01-03' - INTERVAL 1 DAY")
def retention(spark, d):
    return timeseries.retain(read_table(spark, d, "events"), "1d", F.lit("2024-01-03").cast("timestamp")).select("event_id")


@query("SELECT event_type, run::BIGINT AS run, any_value(big) AS value, count(*) AS length FROM (SELECT event_type, big, sum(CASE WHEN big IS DISTINCT FROM p OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM (SELECT event_id, event_type, value > 50 AS big, lag(value > 50) OVER (PARTITION BY event_type ORDER BY event_id) AS p, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)) GROUP BY event_type, run")
def rle(spark, d):
    x = read_table(spark, d, "events").withColumn("big", F.col("value") > 50)
    return columnar.run_length_encode(x, ["event_type"], [F.asc("event_id")], "big")


@query("SELECT round(coalesce(sum(l_tax), 0), 4) AS sum FROM lineitem")
def column_aggregate(spark, d):
    return columnar.column_aggregate(columnar.scan(read_table(spark, d, "lineitem"), ["l_tax"]), "sum", "l_tax").select(F.round("sum", 4).alias("sum"))


# --- full text, space ----------------------------------------------------------------------

_TOKENS = r"(SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"


@query(f"WITH p AS {_TOKENS}, q AS (SELECT * FROM p WHERE term IN ('the', 'thing', 'avec')), w AS (SELECT term, 1 + ln((SELECT count(*) FROM documents) / count(*)) AS w FROM q GROUP BY term) SELECT doc_id, round(sum(w), 6) AS relevance FROM q JOIN w USING (term) GROUP BY doc_id")
def fulltext_ranked(spark, d):
    return fulltext.match_any(read_table(spark, d, "documents"), "doc_id", ["text"], "the thing avec").select("doc_id", F.round("relevance", 6).alias("relevance"))


@query(f"WITH p AS {_TOKENS}, q AS (SELECT * FROM p WHERE term IN ('nicht', 'of')), w AS (SELECT term, 1 + ln((SELECT count(*) FROM documents) / count(*)) AS w FROM q GROUP BY term) SELECT doc_id, round(sum(w), 6) AS relevance FROM q JOIN w USING (term) GROUP BY doc_id")
def fulltext_indexed(spark, d):
    docs = read_table(spark, d, "documents")
    index = fulltext.build_index(docs, "doc_id", ["text"])
    return fulltext.match_any(docs, "doc_id", ["text"], "of nicht", index).select("doc_id", F.round("relevance", 6).alias("relevance"))


@query("SELECT doc_id, (contains(lower(text), 'idiot')::INT + contains(lower(text), 'license')::INT) AS relevance FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license')")
def fulltext_contains(spark, d):
    return fulltext.match_contains(read_table(spark, d, "documents"), ["text"], "license idiot").select("doc_id", "relevance")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of the') AND NOT contains(lower(text), 'password')")
def fulltext_boolean(spark, d):
    return fulltext.match_boolean(read_table(spark, d, "documents"), ["text"], '+the "of the" -password sometimes').select("doc_id")


_POINT = "SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part"


@query(f"SELECT p_partkey, sqrt(pow(x - 10.0, 2) + pow(y - 12.0, 2)) AS distance FROM ({_POINT})")
def st_distance(spark, d):
    p = read_table(spark, d, "part").withColumn("pos", spatial.point(F.col("p_size"), F.col("p_retailprice") / 100))
    return p.select("p_partkey", spatial.st_distance(F.col("pos"), spatial.point(10, 12)).alias("distance"))


@query(f"SELECT p_partkey FROM ({_POINT}) WHERE sqrt(pow(x - 25.0, 2) + pow(y - 14.0, 2)) <= 4")
def st_within(spark, d):
    p = read_table(spark, d, "part").withColumn("pos", spatial.point(F.col("p_size"), F.col("p_retailprice") / 100))
    return spatial.st_within(p, "pos", 25.0, 14.0, 4.0).select("p_partkey")


@query(f"WITH p AS ({_POINT}) SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_partkey < b.p_partkey AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.1")
def distance_join(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", spatial.point(F.col("p_size"), F.col("p_retailprice") / 100).alias("pos"))
    a, b = p.toDF("a", "pa"), p.toDF("b", "pb")
    return spatial.distance_join(a, b, "pa", "pb", 0.1).where("a < b").select("a", "b")


# --- streaming in batch form ---------------------------------------------------------------


def _events(spark, d):
    return windows.event_time(read_table(spark, d, "events"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts)) AS start_ms, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value > 10 GROUP BY ALL")
def stream_tumbling(spark, d):
    text = "SELECT event_type, COUNT(*) AS n, AVG(value) AS mean FROM events WINDOW TUMBLING (SIZE 30 MINUTES) WHERE value > 10 GROUP BY event_type"
    return stream_engine.plan(_events(spark, d), stream_engine.parse(text)).select(F.unix_millis("window_start").alias("start_ms"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("WITH b AS (SELECT a.event_id AS anchor, e.event_type FROM events a JOIN events e ON e.ts <= a.ts AND e.ts > a.ts - INTERVAL 10 MINUTE) SELECT anchor, event_type, count(*) AS n FROM b GROUP BY ALL")
def stream_sliding_grouped(spark, d):
    return windows.sliding_grouped(_events(spark, d), 600_000, "event_id", ["event_type"], ["count(*) AS n"])


@query("SELECT l.event_id AS a, r.event_id AS b FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 5 MINUTE AND l.ts + INTERVAL 5 MINUTE WHERE l.event_type = 'click' AND r.event_type = 'purchase'")
def stream_join(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "event_type", "ts")
    out = windows.stream_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", 300_000)
    return out.select(F.col("event_id").alias("a"), F.col("right_event_id").alias("b"))


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_lookup_join(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return windows.lookup_join(_events(spark, d), c, "user_id").select("event_id", "c_mktsegment")


@query("SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR epoch_ms(ts) >= epoch_ms(m) - 86400000")
def stream_late_filter(spark, d):
    return windows.late_filter(_events(spark, d), 86_400_000, ["value", "event_id"], partition=["event_type"]).select("event_id")


# --- changes: the final table state --------------------------------------------------------


def _suppliers(spark, d):
    return read_table(spark, d, "supplier")


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE NOT (s_acctbal < 0) UNION ALL SELECT 100000, 'new', 1.5")
def dml_sequence(spark, d):
    e = Engine(spark)
    e.put("sup_w", _suppliers(spark, d).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
    e.script("INSERT INTO sup_w (s_suppkey, s_name, s_acctbal) VALUES (100000, 'new', 1.5); DELETE FROM sup_w WHERE s_acctbal < 0; UPDATE sup_w SET s_acctbal = s_acctbal * 2 WHERE s_nationkey = 3")
    return e.table("sup_w").drop("s_nationkey")


def _accounts(spark, d):
    """Customers as new rows for the suppliers: some keys match."""
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))


_BOTH = "FROM supplier t FULL JOIN customer s ON s_suppkey = c_custkey"


@query(f"SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, CASE WHEN c_custkey IS NULL THEN s_acctbal WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal + c_acctbal END AS s_acctbal {_BOTH}")
def merge_full(spark, d):
    x = _suppliers(spark, d).select("s_suppkey", "s_acctbal")
    return dml.merge(x, _accounts(spark, d), ["s_suppkey"], matched={"s_acctbal": F.col("t.s_acctbal") + F.col("s.s_acctbal")})


@query("SELECT s_suppkey, s_acctbal FROM supplier ANTI JOIN customer ON s_suppkey = c_custkey UNION ALL SELECT c_custkey, c_acctbal FROM customer ANTI JOIN supplier ON s_suppkey = c_custkey")
def merge_delete(spark, d):
    x = _suppliers(spark, d).select("s_suppkey", "s_acctbal")
    return dml.merge(x, _accounts(spark, d), ["s_suppkey"], delete_matched=True)


@query(f"SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, coalesce(s_acctbal, c_acctbal) AS s_acctbal {_BOTH}")
def upsert_nothing(spark, d):
    x = _suppliers(spark, d).select("s_suppkey", "s_acctbal")
    return dml.upsert(x, _accounts(spark, d), ["s_suppkey"], do_nothing=True)


@query(f"SELECT coalesce(s_suppkey, c_custkey) AS s_suppkey, coalesce(c_acctbal, s_acctbal) AS s_acctbal {_BOTH}")
def upsert_update(spark, d):
    x = _suppliers(spark, d).select("s_suppkey", "s_acctbal")
    return dml.upsert(x, _accounts(spark, d), ["s_suppkey"])


@query(f"SELECT coalesce(c_custkey, s_suppkey) AS s_suppkey, CASE WHEN c_custkey IS NULL THEN s_acctbal ELSE c_acctbal END AS s_acctbal {_BOTH}")
def replace_into(spark, d):
    x = _suppliers(spark, d).select("s_suppkey", "s_acctbal")
    return dml.replace_into(x, _accounts(spark, d), ["s_suppkey"])


@query("SELECT s_suppkey, 'on' AS state FROM supplier WHERE s_suppkey > 3")
def rollback_savepoint(spark, d):
    e = Engine(spark)
    e.put("sup_t", _suppliers(spark, d).select("s_suppkey"))
    e.script("BEGIN; DELETE FROM sup_t WHERE s_suppkey <= 3; SAVEPOINT s; DELETE FROM sup_t; ROLLBACK TO s; COMMIT; ALTER TABLE sup_t ADD COLUMN state STRING DEFAULT 'on'")
    return e.table("sup_t")


# --- scalar functions ----------------------------------------------------------------------


@query("SELECT p_partkey, upper(p_name) AS a, length(p_name)::BIGINT AS b, replace(p_type, 'E', '_') AS c, substr(p_name, 1, 3) AS d, concat(p_brand, '-', p_type) AS e, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS f FROM part")
def fn_string(spark, d):
    n = F.col("p_name")
    return read_table(spark, d, "part").select("p_partkey", F.upper(n).alias("a"), core.length(n).alias("b"), F.replace("p_type", F.lit("E"), F.lit("_")).alias("c"), core.substring(n, 0, 3).alias("d"), core.concat(F.col("p_brand"), F.lit("-"), F.col("p_type")).alias("e"), F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.lit("none")).alias("f"))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS b, CAST(floor(s_acctbal) AS BIGINT) AS c, floor(s_acctbal * 10 + 0.5) / 10 AS d, round(sqrt(abs(s_acctbal)), 6) AS e, round(ln(s_suppkey + 1), 6) AS f, round(sin(s_suppkey), 6) AS g, round(degrees(1.0), 6) AS h, sign(s_acctbal)::DOUBLE AS i, round(pow(s_nationkey, 2), 2) AS j FROM supplier")
def fn_math(spark, d):
    b, k = F.col("s_acctbal"), F.col("s_suppkey")
    m = numeric.MATH
    return _suppliers(spark, d).select("s_suppkey", m["abs"](b).alias("a"), m["ceil"](b).alias("b"), m["floor"](b).alias("c"), core.round_half_up(b, 1).alias("d"), F.round(m["sqrt"](F.abs(b)), 6).alias("e"), F.round(m["log"](k + 1), 6).alias("f"), F.round(m["sin"](k), 6).alias("g"), F.round(m["toDegrees"](F.lit(1.0)), 6).alias("h"), m["signum"](b).alias("i"), F.round(m["pow"](F.col("s_nationkey"), F.lit(2)), 2).alias("j"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey // c_nationkey END::BIGINT AS a, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_custkey % c_nationkey END::BIGINT AS b, (c_custkey & 6)::BIGINT AS c, xor(c_custkey, 5)::BIGINT AS d, (c_custkey << 2)::BIGINT AS e FROM customer")
def fn_compat_bits(spark, d):
    a, b = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    bit = numeric.BITWISE
    return read_table(spark, d, "customer").select("c_custkey", core.int_divide(a, b).alias("a"), core.modulo(a, b).alias("b"), bit["&"](a, F.lit(6).cast("long")).alias("c"), bit["^"](a, F.lit(5).cast("long")).alias("d"), bit["<<"](a, F.lit(2)).alias("e"))


@query("SELECT p_partkey, lower(to_base(p_partkey, 16)) AS hex, '0b' || to_base(p_size, 2) AS bin FROM part")
def fn_radix(spark, d):
    return read_table(spark, d, "part").select("p_partkey", numeric.to_radix(F.col("p_partkey"), 16).alias("hex"), numeric.RADIX["bin"](F.col("p_size")).alias("bin"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '-') AS a, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'else' END AS b, strftime(o_orderdate, '%d/%m/%Y') AS c, (datediff('month', date '1992-01-01', o_orderdate::DATE))::BIGINT AS m, regexp_matches(o_orderpriority, 'U.*T') AS r FROM orders")
def fn_oracle(spark, d):
    s = F.col("o_orderstatus")
    first = F.lit("1992-01-01").cast("date")
    return read_table(spark, d, "orders").select("o_orderkey", oracle.nvl(F.nullif(s, F.lit("F")), F.lit("-")).alias("a"), oracle.decode(s, F.lit("O"), F.lit("open"), F.lit("F"), F.lit("done"), F.lit("else")).alias("b"), oracle.to_char(F.col("o_orderdate"), "DD/MM/YYYY").alias("c"), oracle.months_between(F.to_date("o_orderdate"), first).cast("long").alias("m"), oracle.regexp_like(F.col("o_orderpriority"), "U.*T").alias("r"))


@query("SELECT c_custkey, instr(c_name, '#')::BIGINT AS a, substr(c_name, 1, 1) || 'XX' || substr(c_name, 4) AS b, try_cast(c_mktsegment AS BIGINT) AS c FROM customer")
def fn_mssql(spark, d):
    n = F.col("c_name")
    return read_table(spark, d, "customer").select("c_custkey", mssql.charindex(F.lit("#"), n).alias("a"), mssql.stuff(n, F.lit(2), F.lit(2), F.lit("XX")).alias("b"), mssql.convert("BIGINT", F.col("c_mktsegment")).alias("c"))


@query("SELECT o_orderkey, lpad(o_orderstatus, 3, '*') AS a, coalesce(list_position(['F', 'O'], o_orderstatus), 0)::BIGINT AS b, strftime(o_orderdate, '%Y-%m-%d') AS c FROM orders")
def fn_mysql(spark, d):
    s = F.col("o_orderstatus")
    return read_table(spark, d, "orders").select("o_orderkey", mysql.lpad(s, 3, "*").alias("a"), mysql.field(s, F.lit("F"), F.lit("O")).alias("b"), mysql.date_format(F.col("o_orderdate"), "%Y-%m-%d").alias("c"))


@query("SELECT o_orderkey, md5(o_orderpriority) AS a, left(o_orderpriority, 3) AS b, isodow(o_orderdate)::BIGINT AS dow, quarter(o_orderdate)::BIGINT AS q, ((dayofyear(o_orderdate) - 1) // 7 + 1)::BIGINT AS w, regexp_replace(o_orderpriority, '[A-Z]', 'x') AS r, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS t FROM orders")
def fn_postgres(spark, d):
    p, t = F.col("o_orderpriority"), F.col("o_orderdate")
    return read_table(spark, d, "orders").select("o_orderkey", F.md5(p.cast("binary")).alias("a"), postgres.left(p, 3).alias("b"), postgres.extract("dow", t).alias("dow"), postgres.extract("quarter", t).alias("q"), postgres.extract("week", t).alias("w"), postgres.regexp_replace(p, "[A-Z]", "x").alias("r"), F.date_format(postgres.date_trunc("month", t), "yyyy-MM-dd").alias("t"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, len(list(n_nationkey))::BIGINT AS n, array_to_string(list_sort(list(n_nationkey)) || [99], ',') AS ks FROM nation GROUP BY n_regionkey")
def fn_array(spark, d):
    ks = postgres.array_append(postgres.array_agg(F.col("n_nationkey")), F.lit(99))
    return read_table(spark, d, "nation").groupBy("n_regionkey").agg(postgres.string_agg(F.col("n_name"), "|").alias("names"), postgres.array_length(postgres.array_agg(F.col("n_nationkey"))).alias("n"), F.array_join(ks, ",").alias("ks"))


# --- documents -----------------------------------------------------------------------------


def _orders(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    items = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    return o.join(items, F.col("_id") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("SELECT o_orderkey AS _id FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND o_custkey NOT IN (1, 2, 3)")
def doc_match(spark, d):
    q = {"$or": [{"status": "O"}, {"total": {"$gt": 200000}}], "cust": {"$nin": [1, 2, 3]}}
    return compiler.pipeline(_orders(spark, d), [{"$match": q}, {"$project": {"_id": 1}}])


@query("SELECT o_orderstatus AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top, first(o_orderkey ORDER BY o_orderkey) AS f FROM orders GROUP BY o_orderstatus")
def doc_group(spark, d):
    out = compiler.pipeline(_orders(spark, d), [{"$group": {"_id": "$status", "n": {"$sum": 1}, "total": {"$sum": "$total"}, "top": {"$max": "$total"}, "f": {"$first": "$_id"}}}])
    return out.withColumn("total", F.round("total", 2))


@query("SELECT l_linenumber AS _id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_linenumber")
def doc_unwind(spark, d):
    return compiler.pipeline(_orders(spark, d), [{"$unwind": "$lines"}, {"$group": {"_id": "$lines", "n": {"$sum": 1}}}])


@query("SELECT c_custkey AS _id, count(o_orderkey)::INT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def doc_lookup(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("_id"))
    others = {"orders": read_table(spark, d, "orders").select("o_orderkey", "o_custkey")}
    out = compiler.pipeline(c, [{"$lookup": {"from": "orders", "localField": "_id", "foreignField": "o_custkey", "as": "os"}}], others.__getitem__)
    return out.select("_id", F.size("os").alias("n"))


@query("SELECT o_orderkey AS _id, lower(o_orderstatus) || '-' || o_custkey AS tag, o_totalprice * 2.0 AS twice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def doc_add_fields(spark, d):
    stages = [{"$sort": {"total": -1, "_id": 1}}, {"$skip": 5}, {"$limit": 25}, {"$addFields": {"tag": {"$concat": [{"$toLower": "$status"}, "-", {"$toString": "$cust"}]}, "twice": {"$multiply": ["$total", 2]}}}, {"$project": {"tag": 1, "twice": 1}}]
    return compiler.pipeline(_orders(spark, d), stages)


@query("SELECT count(*) AS n FROM orders WHERE regexp_matches(o_orderstatus, '^[FO]')")
def doc_count(spark, d):
    return compiler.pipeline(_orders(spark, d), [{"$match": {"status": {"$regex": "^[FO]"}}}, {"$count": "n"}])


@query("SELECT o_orderkey AS _id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1.5 ELSE o_totalprice END AS total, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS cust, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS status FROM orders")
def doc_update_ops(spark, d):
    rows = _orders(spark, d).drop("lines")
    return compiler.apply_update(rows, compiler.where({"status": "F"}), {"$inc": {"total": 1.5}, "$unset": {"cust": ""}, "$set": {"status": "closed"}}).select("_id", "total", "cust", "status")


def queries() -> dict:
    """Name to query function."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(SQL)
