"""Queries through the engine's text and object surfaces, whose final state SQL can check."""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill import plugins
from lumenmill.documents import compiler
from lumenmill.documents.collection import DocumentStore, Pipeline, Query, Update
from lumenmill.documents.cql import CqlSession
from lumenmill.functions import numeric, registry
from lumenmill.operators import spatial
from lumenmill.operators.dml import EngineError
from lumenmill.plans.expressions import Script, call, compile_column, if_, lit, op, var
from lumenmill.session import Engine
from lumenmill.sources.tables import read_table
from lumenmill.streaming import windows
from lumenmill.streaming.engine import StreamEngine

QUERIES: dict = {}
SQL: dict[str, str] = {}
_sinks = itertools.count()


def query(sql: str):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _engine(spark: SparkSession, d: str, dialect: str = "core", **tables: str) -> Engine:
    """An engine with names for projections of the input tables."""
    e = Engine(spark, dialect)
    for name, spec in tables.items():
        source, _, cols = spec.partition(":")
        rows = read_table(spark, d, source)
        e.put(name, rows.selectExpr(*[c.strip() for c in cols.split(";")]) if cols else rows)
    return e


NATION = "nation:CAST(n_nationkey AS INT) AS id; n_name AS name; CAST(n_regionkey AS INT) AS region"
SUPPLIER = "supplier:CAST(s_suppkey AS INT) AS id; s_name AS name; CAST(s_nationkey AS INT) AS nation; s_acctbal AS bal"

# --- definitions ---------------------------------------------------------------------------


@query("SELECT n_nationkey::INT AS id, upper(n_name) AS up FROM nation WHERE n_regionkey < 3")
def view_scan(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.execute("CREATE VIEW some AS SELECT * FROM nat WHERE region < 3")
    e.execute("CREATE OR REPLACE VIEW loud AS SELECT id, upper(name) AS up FROM some")
    return e.query("SELECT * FROM loud")


@query("SELECT n_nationkey::INT AS id, n_name AS name, n_regionkey * 1.5 AS price, n_regionkey > 1 AS flag, 'x' AS doc FROM nation")
def create_table_types(spark, d):
    e = _engine(spark, d, "mssql", nat=NATION)
    e.execute("CREATE TABLE wide (id MEDIUMINT, name NVARCHAR(25), price MONEY, flag BIT, made DATETIME2, doc JSONB, tag UNIQUEIDENTIFIER, more VARCHAR2(9), d DOUBLE PRECISION, t TIMESTAMP WITH TIME ZONE)")
    e.execute("INSERT INTO wide (id, name, price, flag, doc) SELECT id, name, region * 1.5, region > 1, 'x' FROM nat")
    return e.query("SELECT id, name, CAST(price AS DOUBLE) AS price, flag, doc FROM wide WHERE made IS NULL")


@query("SELECT n_regionkey::INT AS region, sum(n_nationkey * 1.25)::DOUBLE AS total FROM nation GROUP BY n_regionkey")
def create_table_oracle(spark, d):
    e = _engine(spark, d, "oracle", nat=NATION)
    e.execute("CREATE TABLE sums (region NUMBER(10), total NUMBER(12, 2), note CLOB)")
    e.execute("INSERT INTO sums (region, total) SELECT region, sum(id * 1.25) FROM nat GROUP BY region")
    return e.query("SELECT CAST(region AS INT) AS region, CAST(total AS DOUBLE) AS total FROM sums")


@query("SELECT 'TABLE_NOT_FOUND' AS first, 25 AS n")
def drop_table(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.script("CREATE TABLE gone (id INT); DROP TABLE gone; DROP TABLE IF EXISTS gone")
    code = _code(lambda: e.table("gone"))
    e.script("CREATE TABLE gone (other INT); INSERT INTO gone SELECT id FROM nat")
    return e.query(f"SELECT '{code}' AS first, CAST(count(other) AS INT) AS n FROM gone")


@query("SELECT n_nationkey::INT AS id, n_name AS title, 'on' AS status FROM nation")
def alter_table(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.script("ALTER TABLE nat ADD COLUMN state VARCHAR(5) DEFAULT 'on'; ALTER TABLE nat RENAME COLUMN state TO status; ALTER TABLE nat RENAME COLUMN name TO title")
    e.script("ALTER TABLE nat DROP COLUMN region; ALTER TABLE nat ADD CONSTRAINT pk PRIMARY KEY (id); ALTER TABLE nat ADD CONSTRAINT c CHECK (id >= 0)")
    return e.table("nat")


@query("SELECT * FROM (VALUES ('by_name', 'UNIQUE_VIOLATION'), ('by_region', 'ok')) t(made, outcome)")
def create_index(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.execute("CREATE INDEX by_region ON nat (region)")
    e.execute("CREATE UNIQUE INDEX by_name ON nat (name)")
    tries = {"by_name": "INSERT INTO nat SELECT 99, name, 0 FROM nat WHERE id = 3", "by_region": "INSERT INTO nat VALUES (100, 'new', 1)"}
    return spark.createDataFrame([(k, _code(lambda t=t: e.execute(t))) for k, t in tries.items()], "made string, outcome string")


@query("SELECT 10000::BIGINT AS n, sum(i)::BIGINT AS total, max(i * 2)::BIGINT AS top FROM range(10000) t(i)")
def batch_insert(spark, d):
    e = Engine(spark)
    e.execute("CREATE TABLE batch_t (id INT PRIMARY KEY, v BIGINT)")
    e.insert_batch("batch_t", ["id", "v"], [(i, 2 * i) for i in range(10_000)])
    return e.query("SELECT count(*) AS n, sum(id) AS total, max(v) AS top FROM batch_t")


@query("SELECT 40::BIGINT AS n, 780::BIGINT AS total")
def single_inserts(spark, d):
    e = Engine(spark)
    e.execute("CREATE TABLE one_t (id INT PRIMARY KEY)")
    for i in range(40):
        e.execute(f"INSERT INTO one_t VALUES ({i})")
    return e.query("SELECT count(*) AS n, sum(id) AS total FROM one_t")


@query("SELECT * FROM (VALUES ('nat'), ('sup'), ('v')) t(name)")
def show_tables(spark, d):
    _engine(spark, d, elsewhere=NATION)
    e = _engine(spark, d, "mysql", nat=NATION, sup=SUPPLIER)
    e.execute("CREATE VIEW v AS SELECT id FROM nat")
    return e.query("SHOW TABLES").select(F.col("tableName").alias("name"))


@query("SELECT 'a' AS who, 25::BIGINT AS n UNION ALL SELECT 'b', 0")
def two_engines(spark, d):
    a, b = _engine(spark, d, same=NATION), Engine(spark)
    b.execute("CREATE TABLE same (id INT)")
    first = a.query("SELECT 'a' AS who, count(*) AS n FROM same")
    return first.unionByName(b.query("SELECT 'b' AS who, count(*) AS n FROM same"))


def _code(act) -> str:
    """ok, or the code of the error."""
    try:
        act()
    except EngineError as e:
        return e.error_code
    return "ok"


# --- queries of dialects -------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '(STANDARD|SMALL).*(TIN|STEEL)')")
def similar_to(spark, d):
    return _engine(spark, d, "postgresql", part="part").query("SELECT p_partkey FROM part WHERE p_type SIMILAR TO '(STANDARD|SMALL)%(TIN|STEEL)'")


@query('SELECT n_name AS "the name" FROM nation WHERE n_nationkey < 9')
def quoted_names(spark, d):
    return _engine(spark, d, "postgresql", nat=NATION).query('SELECT "name" AS "the name" FROM nat WHERE "id" < 9')


@query("SELECT 7::BIGINT AS n, 3 AS two")
def rownum_dual(spark, d):
    e = _engine(spark, d, "oracle", nat=NATION)
    few = e.query("SELECT id FROM nat WHERE ROWNUM <= 7")
    return few.agg(F.count("*").alias("n")).crossJoin(e.query("SELECT 1 + 2 AS two FROM DUAL"))


@query("SELECT n_regionkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2")
def minus_set(spark, d):
    return _engine(spark, d, "oracle", n="nation", r="region").query("SELECT n_regionkey AS k FROM n MINUS SELECT r_regionkey FROM r WHERE r_regionkey > 2")


@query("SELECT * FROM (VALUES (5, 'a'), (15, 'b'), (15, 'c')) t(id, name)")
def sequences(spark, d):
    e = Engine(spark, "oracle")
    e.script("CREATE SEQUENCE sq START WITH 5 INCREMENT BY 10; CREATE TABLE seq_t (id INT, name VARCHAR2(5))")
    e.script("INSERT INTO seq_t VALUES (sq.NEXTVAL, 'a'); INSERT INTO seq_t VALUES (sq.NEXTVAL, 'b'); INSERT INTO seq_t VALUES (sq.CURRVAL, 'c')")
    return e.table("seq_t")


@query("SELECT s_suppkey, s_nationkey, quantile_cont(s_acctbal, 0.25) OVER (PARTITION BY s_nationkey) AS q, quantile_disc(s_acctbal, 0.5) OVER (PARTITION BY s_nationkey) AS m FROM supplier")
def percentile_over(spark, d):
    return _engine(spark, d, sup="supplier").query(
        "SELECT s_suppkey, s_nationkey, PERCENTILE_CONT(0.25) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS q, "
        "PERCENTILE_DISC(0.5) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS m FROM sup"
    )


@query("SELECT o_orderkey, format('{:.2f}', round(o_totalprice, 2)) AS plain FROM orders WHERE o_totalprice >= 1000")
def to_char_number(spark, d):
    out = _engine(spark, d, "oracle", o="orders").query("SELECT o_orderkey, TO_CHAR(o_totalprice, '9,999,990.00') AS t FROM o WHERE o_totalprice >= 1000")
    return out.select("o_orderkey", F.regexp_replace("t", ",", "").alias("plain"))


# --- rows ----------------------------------------------------------------------------------


@query("SELECT n_nationkey::INT AS id, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name) FROM nation WHERE n_regionkey = 1")
def insert_select(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.execute("CREATE TABLE copy_t (id INT PRIMARY KEY, name STRING)")
    e.script("INSERT INTO copy_t SELECT id, name FROM nat; INSERT INTO copy_t (name, id) SELECT lower(name), id + 100 FROM nat WHERE region = 1")
    return e.table("copy_t")


@query("SELECT * FROM (VALUES ('null', 'NOT_NULL_VIOLATION'), ('key', 'UNIQUE_VIOLATION'), ('twice', 'UNIQUE_VIOLATION'), ('check', 'CHECK_VIOLATION'), ('parent', 'FOREIGN_KEY_VIOLATION'), ('child', 'FOREIGN_KEY_VIOLATION'), ('fine', 'ok')) t(what, outcome)")
def constraint_checks(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.execute("ALTER TABLE nat ADD PRIMARY KEY (id)")
    e.execute("CREATE TABLE child_t (id INT PRIMARY KEY, nation INT REFERENCES nat(id), n INT NOT NULL CHECK (n > 0))")
    e.execute("INSERT INTO child_t SELECT id, id, id + 1 FROM nat")
    tries = {
        "null": "INSERT INTO child_t VALUES (100, 1, NULL)", "key": "INSERT INTO child_t VALUES (3, 1, 1)", "twice": "INSERT INTO child_t VALUES (101, 1, 1), (101, 2, 1)",
        "check": "UPDATE child_t SET n = n - 5", "parent": "INSERT INTO child_t VALUES (102, 777, 1)", "child": "DELETE FROM nat WHERE id = 4", "fine": "INSERT INTO child_t VALUES (103, NULL, 1)",
    }
    return spark.createDataFrame([(k, _code(lambda t=t: e.execute(t))) for k, t in tries.items()], "what string, outcome string")


@query("SELECT count(*)::BIGINT AS n, min(i)::INT AS lo, max(i)::INT AS hi, count(DISTINCT i)::BIGINT AS ids FROM range(1, 27) t(i)")
def auto_increment(spark, d):
    e = _engine(spark, d, "mysql", nat=NATION)
    e.execute("CREATE TABLE auto_t (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(25))")
    e.script("INSERT INTO auto_t (name) VALUES ('first'); INSERT INTO auto_t (name) SELECT name FROM nat")
    return e.query("SELECT count(*) AS n, min(id) AS lo, max(id) AS hi, count(DISTINCT id) AS ids FROM auto_t")


@query("SELECT 1 AS id, 'a' AS name, 25::BIGINT AS rows, 26 AS last")
def serial_returning(spark, d):
    e = _engine(spark, d, "postgresql", nat=NATION)
    e.execute("CREATE TABLE ser_t (id SERIAL PRIMARY KEY, name TEXT)")
    one = e.execute("INSERT INTO ser_t (name) VALUES ('a') RETURNING id, name")
    more = e.execute("INSERT INTO ser_t (name) SELECT name FROM nat RETURNING id")
    return one.crossJoin(more.agg(F.count("*").alias("rows"), F.max("id").alias("last")))


@query("SELECT s_suppkey::INT AS id, s_acctbal * 2 AS bal FROM supplier WHERE s_nationkey = 3")
def update_returning(spark, d):
    e = _engine(spark, d, "postgresql", sup=SUPPLIER)
    return e.execute("UPDATE sup SET bal = bal * 2 WHERE nation = 3 RETURNING id, bal")


@query("SELECT s_suppkey::INT AS id FROM supplier WHERE s_acctbal < 0")
def delete_returning(spark, d):
    return _engine(spark, d, "postgresql", sup=SUPPLIER).execute("DELETE FROM sup WHERE bal < 0 RETURNING id")


@query("SELECT n_nationkey::INT + 50 AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def output_inserted(spark, d):
    e = _engine(spark, d, "mssql", nat=NATION)
    e.execute("CREATE TABLE out_t (id INT, name VARCHAR(25))")
    return e.execute("INSERT INTO out_t (id, name) OUTPUT INSERTED.id, INSERTED.name SELECT id + 50, name FROM nat WHERE region = 2")


_UPSERTED = """SELECT s_suppkey::INT AS id, CASE WHEN c_custkey IS NULL THEN s_acctbal ELSE s_acctbal + c_acctbal END AS bal FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_custkey % 3 = 0
UNION ALL SELECT c_custkey::INT, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""


@query(_UPSERTED)
def on_conflict_text(spark, d):
    e = _engine(spark, d, "postgresql", sup="supplier:CAST(s_suppkey AS INT) AS id; s_acctbal AS bal", cust="customer:CAST(c_custkey AS INT) AS id; c_acctbal AS bal")
    e.execute("INSERT INTO sup SELECT id, bal FROM cust WHERE id % 3 = 0 ON CONFLICT (id) DO UPDATE SET bal = bal + EXCLUDED.bal")
    return e.table("sup")


@query(_UPSERTED)
def on_duplicate_key(spark, d):
    e = _engine(spark, d, "mysql", sup="supplier:CAST(s_suppkey AS INT) AS id; s_acctbal AS bal", cust="customer:CAST(c_custkey AS INT) AS id; c_acctbal AS bal")
    e.execute("ALTER TABLE sup ADD PRIMARY KEY (id)")
    e.execute("INSERT INTO sup SELECT id, bal FROM cust WHERE id % 3 = 0 ON DUPLICATE KEY UPDATE bal = bal + VALUES(bal)")
    return e.table("sup")


MERGE_TABLES = {"acc": "supplier:CAST(s_suppkey AS INT) AS id; s_acctbal AS v; s_name AS name", "src": "customer:CAST(c_custkey AS INT) AS k; c_acctbal AS v; c_name AS name"}


@query("""SELECT s_suppkey::INT AS id, CASE WHEN c_custkey IS NULL THEN s_acctbal ELSE s_acctbal + c_acctbal * 2 END AS v, s_name AS name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey
UNION ALL SELECT c_custkey::INT, c_acctbal * 2, NULL FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def merge_text_expressions(spark, d):
    """Unequal key names, and values that are expressions over some of the columns."""
    e = _engine(spark, d, **MERGE_TABLES)
    e.execute("MERGE INTO acc t USING src s ON t.id = s.k WHEN MATCHED THEN UPDATE SET v = t.v + s.v * 2 WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.k, s.v * 2)")
    return e.table("acc")


@query("""SELECT s_suppkey::INT AS id, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS v FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey WHERE c_acctbal IS NULL OR c_acctbal <= 5000
UNION ALL SELECT c_custkey::INT, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def merge_text_conditions(spark, d):
    """Clauses with conditions, the first that holds counts."""
    e = _engine(spark, d, **MERGE_TABLES)
    e.execute("MERGE INTO acc t USING src s ON t.id = s.k WHEN MATCHED AND s.v > 5000 THEN DELETE WHEN MATCHED AND s.v < 0 THEN UPDATE SET v = 0.0 WHEN NOT MATCHED AND s.v > 9000 THEN INSERT (id, v, name) VALUES (k, v, name)")
    return e.table("acc").select("id", "v")


@query("""SELECT s_suppkey::INT AS id, coalesce(n, s_acctbal) AS v FROM supplier LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n FROM orders GROUP BY 1) ON o_custkey = s_suppkey
UNION ALL SELECT o_custkey::INT, count(*)::DOUBLE FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def merge_text_subquery(spark, d):
    """A subquery as the source."""
    e = _engine(spark, d, o="orders", **MERGE_TABLES)
    e.execute("MERGE INTO acc AS a USING (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY o_custkey) AS q ON a.id = q.o_custkey WHEN MATCHED THEN UPDATE SET v = q.n WHEN NOT MATCHED THEN INSERT (id, v, name) VALUES (q.o_custkey, q.n, 'new')")
    return e.table("acc").select("id", "v")


@query("SELECT s_suppkey::INT AS id, s_acctbal AS v FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def merge_by_source(spark, d):
    e = _engine(spark, d, **MERGE_TABLES)
    e.execute("MERGE INTO acc t USING (SELECT k FROM src WHERE v > 0) s ON t.id = s.k WHEN NOT MATCHED BY SOURCE THEN DELETE")
    return e.table("acc").select("id", "v")


@query("SELECT * FROM (VALUES ('twice', 'MERGE_CARDINALITY'), ('where', 'UNSUPPORTED_MERGE')) t(what, outcome)")
def merge_errors(spark, d):
    e = _engine(spark, d, n=NATION, **MERGE_TABLES)
    tries = {
        "twice": "MERGE INTO acc t USING (SELECT 1 AS k UNION ALL SELECT 1) s ON t.id = s.k WHEN MATCHED THEN UPDATE SET v = 1",
        "where": "MERGE INTO acc t USING src s ON t.id = s.k WHEN MATCHED THEN UPDATE SET v = 1 DELETE WHERE v > 0",
    }
    return spark.createDataFrame([(k, _code(lambda t=t: e.execute(t))) for k, t in tries.items()], "what string, outcome string")


# --- control -------------------------------------------------------------------------------


@query("SELECT 'nat' AS what, 20::BIGINT AS n UNION ALL SELECT 'audit', 2")
def triggers(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.execute("CREATE TABLE audit (what STRING)")
    e.script("CREATE TRIGGER a AFTER DELETE ON nat INSERT INTO audit VALUES ('gone'); CREATE TRIGGER b BEFORE UPDATE ON nat FOR EACH STATEMENT INSERT INTO audit VALUES ('new')")
    e.script("DELETE FROM nat WHERE region = 1; UPDATE nat SET name = lower(name)")
    return e.query("SELECT 'nat' AS what, count(*) AS n FROM nat UNION ALL SELECT 'audit', count(*) FROM audit")


@query("SELECT n_nationkey::INT AS id, n_name || '!' AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8")
def procedure_parameters(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.execute("CREATE PROCEDURE keep(r INT, least INT, mark VARCHAR(3)) AS BEGIN DELETE FROM nat WHERE region <> r; UPDATE nat SET name = concat(name, mark); SELECT id, name FROM nat WHERE id > least; END")
    return e.execute("CALL keep(1 + 1, 8, '!')")


@query("SELECT 5::BIGINT AS n")
def do_block(spark, d):
    e = _engine(spark, d, "postgresql", nat=NATION)
    return e.execute("DO $$ BEGIN DELETE FROM nat WHERE region <> 4; SELECT count(*) AS n FROM nat; END $$")


@query("SELECT 42 AS x, 'value 42' AS message, 5::BIGINT AS n")
def variables_print(spark, d):
    e = _engine(spark, d, "mssql", nat=NATION)
    for text in ("DECLARE @x INT = 40", "SET @x = @x + 2", "DECLARE @r INT", "SET @r = 3"):
        e.execute(text)
    said = e.execute("PRINT concat('value ', @x)")
    return e.query("SELECT @x AS x").crossJoin(said).crossJoin(e.query("SELECT count(*) AS n FROM nat WHERE region = @r"))


@query("SELECT 'caught' AS r, 25::BIGINT AS n")
def try_catch(spark, d):
    e = _engine(spark, d, "mssql", nat=NATION)
    got = e.execute("BEGIN TRY SELECT raise_error('no') AS r FROM nat END TRY BEGIN CATCH SELECT 'caught' AS r END CATCH")
    return got.crossJoin(e.query("SELECT count(*) AS n FROM nat"))


@query("SELECT 5::BIGINT AS n, 5 AS changed, 6 AS ident")
def temp_tables(spark, d):
    e = _engine(spark, d, "mssql", nat=NATION)
    e.script("CREATE TABLE #tmp (id INT IDENTITY PRIMARY KEY, name VARCHAR(25)); INSERT INTO #tmp (name) VALUES ('x'); INSERT INTO #tmp (name) SELECT name FROM nat WHERE region = 0")
    e.execute("UPDATE #tmp SET name = lower(name) WHERE id > 1")
    return e.query("SELECT count(*) AS n, @@ROWCOUNT AS changed, @@IDENTITY AS ident FROM #tmp WITH (NOLOCK) WHERE id > 1")


@query("SELECT 'SERIALIZABLE' AS level, 25::BIGINT AS n")
def isolation(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.script("SET TRANSACTION ISOLATION LEVEL SERIALIZABLE; BEGIN; DELETE FROM nat; ROLLBACK")
    return e.query(f"SELECT '{e.variables['isolation']}' AS level, count(*) AS n FROM nat")


# --- functions of dialects, as text --------------------------------------------------------

_O = "orders:o_orderkey AS k; o_orderdate AS t; o_orderpriority AS p; o_totalprice AS price; o_orderstatus AS st"


@query("""SELECT o_orderkey AS k, CASE WHEN nullif(o_orderstatus, 'O') IS NULL THEN 'none' ELSE 'some' END AS a, strftime(o_orderdate::DATE, '%Y-%m-%d') AS b, 12.5 AS c,
strftime((o_orderdate::DATE + INTERVAL 2 MONTH), '%Y-%m-%d') AS e, strftime(date_trunc('month', o_orderdate::DATE), '%Y-%m-%d') AS f, regexp_extract(o_orderpriority, '[A-Z]+') AS g, o_orderdate::DATE <= current_date AS h FROM orders""")
def oracle_text(spark, d):
    return _engine(spark, d, "oracle", o=_O).query(
        "SELECT k, NVL2(nullif(st, 'O'), 'some', 'none') AS a, TO_CHAR(TO_DATE(TO_CHAR(t, 'YYYY/MM/DD'), 'YYYY/MM/DD'), 'YYYY-MM-DD') AS b, TO_NUMBER('12.5') AS c, "
        "TO_CHAR(ADD_MONTHS(t, 2), 'YYYY-MM-DD') AS e, TO_CHAR(TRUNC(t, 'MM'), 'YYYY-MM-DD') AS f, REGEXP_SUBSTR(p, '[A-Z]+') AS g, to_date(t) <= SYSDATE AS h FROM o"
    )


@query("""SELECT o_orderkey AS k, coalesce(nullif(o_orderstatus, 'O'), '-') AS a, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS b, strftime(o_orderdate::DATE + 10, '%Y-%m-%d') AS c,
length(o_orderpriority)::INT AS e, 36::INT AS f, current_date >= o_orderdate::DATE AS g, CASE WHEN contains(upper(o_orderpriority), 'I') THEN 1 ELSE 0 END AS h FROM orders""")
def mssql_text(spark, d):
    return _engine(spark, d, "mssql", o=_O).query(
        "SELECT k, ISNULL(nullif(st, 'O'), '-') AS a, CAST(DATEDIFF(DAY, '1995-01-01', t) AS BIGINT) AS b, CAST(DATEADD(DAY, 10, t) AS STRING) AS c, LEN(concat(p, '  ')) AS e, "
        "length(NEWID()) AS f, GETDATE() >= to_date(t) AS g, PATINDEX('%I%', p) AS h FROM o"
    )


@query("""SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS a, coalesce(nullif(o_orderstatus, 'F'), 'f') AS b, strpos(o_orderpriority, 'E')::INT AS c, strpos(o_orderpriority, '-')::INT AS e,
rpad(o_orderstatus, 3, '*') AS f, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 0 END AS g, strftime(o_orderdate::DATE, '%d.%m.%Y') AS h, epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT AS u FROM orders""")
def mysql_text(spark, d):
    return _engine(spark, d, "mysql", o=_O).query(
        "SELECT k, IF(price > 100000, 'high', 'low') AS a, IFNULL(nullif(st, 'F'), 'f') AS b, LOCATE('E', p) AS c, INSTR(p, '-') AS e, RPAD(st, 3, '*') AS f, CAST(FIND_IN_SET(st, 'F,O,P') AS INT) AS g, "
        "DATE_FORMAT(STR_TO_DATE(DATE_FORMAT(t, '%Y-%m-%d'), '%Y-%m-%d'), '%d.%m.%Y') AS h, UNIX_TIMESTAMP(to_date(t)) AS u FROM o"
    )


@query("""SELECT o_orderkey AS k, strftime(o_orderdate::DATE, '%Y/%m') AS a, array_to_string(regexp_extract_all(o_orderpriority, '[A-Z]+'), '+') AS b, right(o_orderpriority, 3) AS c, 'k=' || o_orderkey AS e,
array_to_string([o_orderstatus, 'x', 'y'], '') AS f, concat_ws('/', o_orderstatus, o_orderpriority) AS g, '1970-01-02' AS h FROM orders""")
def postgres_text(spark, d):
    return _engine(spark, d, "postgresql", o=_O).query(
        "SELECT k, TO_CHAR(t, 'YYYY/MM') AS a, array_join(REGEXP_MATCHES(p, '[A-Z]+'), '+') AS b, RIGHT(p, 3) AS c, FORMAT('k=%s', k) AS e, array_join(ARRAY_CAT(ARRAY[st], ARRAY['x', 'y']), '') AS f, "
        "CONCAT_WS('/', st, p) AS g, date_format(TO_TIMESTAMP(86400), 'yyyy-MM-dd') AS h FROM o"
    )


@query("""SELECT n_nationkey AS k, abs(n_regionkey - 2)::BIGINT AS a, ceil(n_nationkey / 4.0)::BIGINT AS b, floor(n_nationkey / 4.0)::BIGINT AS c, floor(n_nationkey / 4.0 + 0.5)::BIGINT AS e, round(cbrt(n_nationkey), 9) AS f,
round(exp(n_nationkey / 10.0), 6) AS g, round(log10(n_nationkey + 1), 9) AS h, round(log2(n_nationkey + 1), 9) AS i, round(sin(n_nationkey) + cos(n_nationkey) + tan(n_nationkey), 6) AS j,
round(asin(n_nationkey / 30.0) + acos(n_nationkey / 30.0) + atan(n_nationkey), 9) AS l, round(radians(n_nationkey) + degrees(n_nationkey), 6) AS m, round(atan2(n_nationkey, 3), 9) AS n, round(pi() + exp(1.0), 9) AS o,
greatest(n_nationkey, n_regionkey)::BIGINT AS p, least(n_nationkey, n_regionkey)::BIGINT AS q FROM nation""")
def math_functions(spark, d):
    m, k, r = numeric.MATH, F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    q = k / 4.0
    return read_table(spark, d, "nation").select(
        F.col("n_nationkey").alias("k"), m["abs"](r - 2).alias("a"), m["ceil"](q).alias("b"), m["floor"](q).alias("c"), m["round"](q).alias("e"), F.round(m["cbrt"](k), 9).alias("f"), F.round(m["exp"](k / 10.0), 6).alias("g"),
        F.round(m["log10"](k + 1), 9).alias("h"), F.round(m["log2"](k + 1), 9).alias("i"), F.round(m["sin"](k) + m["cos"](k) + m["tan"](k), 6).alias("j"), F.round(m["asin"](k / 30.0) + m["acos"](k / 30.0) + m["atan"](k), 9).alias("l"),
        F.round(m["toRadians"](k) + m["toDegrees"](k), 6).alias("m"), F.round(m["atan2"](k, F.lit(3)), 9).alias("n"), F.round(m["PI"]() + m["E"](), 9).alias("o"), m["max"](k, r).alias("p"), m["min"](k, r).alias("q"),
    )


@query("SELECT o_orderkey AS k, o_orderkey::BIGINT AS back, 1069547520 AS bits, 1.5::FLOAT AS again, o_totalprice::FLOAT::DOUBLE AS f FROM orders")
def conversions(spark, d):
    c, k, price = numeric.CONVERSION, F.col("o_orderkey"), F.col("o_totalprice")
    made = [numeric.double_to_long_bits(k.cast("double")), numeric.float_to_int_bits(F.lit(1.5).cast("float"))]
    assert c  # the table of casts by name
    return read_table(spark, d, "orders").select(
        k.alias("k"), numeric.long_bits_to_double(made[0]).cast("long").alias("back"), made[1].alias("bits"), numeric.int_bits_to_float(made[1]).alias("again"), price.cast("float").cast("double").alias("f")
    )


@query("SELECT n_nationkey AS k, n_nationkey::BIGINT AS a, '0b' || bin(n_nationkey) AS b, n_nationkey::BIGINT AS c FROM nation")
def radix_round_trip(spark, d):
    k, r = F.col("n_nationkey"), numeric.RADIX
    return read_table(spark, d, "nation").select(k.alias("k"), r["parseRadix"](r["toRadix"](k, 7), 7).alias("a"), r["bin"](k).alias("b"), numeric.parse_literal(r["oct"](k)).alias("c"))


# --- special engines -----------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice BETWEEN 950 AND 1200")
def st_contains(spark, d):
    p = spatial.point(F.col("p_size"), F.col("p_retailprice"))
    return read_table(spark, d, "part").where(spatial.st_contains(spatial.point(5, 950), spatial.point(20, 1200), p)).select("p_partkey")


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents), c AS (SELECT count(*) AS n, sum(list_contains(w, 'time')::INT) AS a, sum(list_contains(w, 'house')::INT) AS b FROM t)
SELECT doc_id, round(CASE WHEN list_contains(w, 'time') THEN 1 + ln(n / greatest(a, 1)) ELSE 0 END + CASE WHEN list_contains(w, 'house') THEN 1 + ln(n / greatest(b, 1)) ELSE 0 END, 9) AS relevance FROM t, c WHERE list_contains(w, 'time') OR list_contains(w, 'house')""")
def fulltext_index_text(spark, d):
    e = _engine(spark, d, docs="documents:doc_id; text")
    e.execute("CREATE FULLTEXT INDEX ft ON docs (text)")
    return e.query("SELECT doc_id, MATCH(text) AGAINST('time house') AS relevance FROM docs WHERE MATCH(text) AGAINST('time house')").withColumn("relevance", F.round("relevance", 9))


@query("SELECT count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_text(spark, d):
    e = _engine(spark, d, ev="events:CAST(ts AS TIMESTAMP) AS ts")
    e.execute("CREATE TABLE kept (ts TIMESTAMP) WITH (retention='7d')")
    e.execute("INSERT INTO kept SELECT ts FROM ev")
    last = e.query("SELECT max(ts) AS m FROM kept").first()["m"]
    e.apply_retention("kept", "ts", f"TIMESTAMP'{last}'")
    return e.query("SELECT count(*) AS n FROM kept")


@query("SELECT n_regionkey::INT AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def columnar_text(spark, d):
    e = _engine(spark, d, nat=NATION)
    e.execute("CREATE TABLE col_t (id INT, region INT) ENGINE=COLUMNAR")
    e.execute("INSERT INTO col_t SELECT id, region FROM nat")
    return e.query("SELECT region, count(*) AS n FROM col_t GROUP BY region")


# --- streams -------------------------------------------------------------------------------


def _stream(spark: SparkSession) -> StreamEngine:
    """60 readings of three sensors, one a second."""
    e = StreamEngine(spark)
    e.execute("CREATE STREAM readings (sensor VARCHAR, v INTEGER, ts TIMESTAMP) WITH (kafka_topic='t')")
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    e.ingest("readings", [("abc"[i % 3], i, start + dt.timedelta(seconds=i)) for i in range(60)])
    return e


_READINGS = "SELECT substr('abc', i % 3 + 1, 1) AS sensor, i::INT AS v FROM range(60) t(i)"


@query(f"SELECT sensor, v FROM ({_READINGS}) WHERE v > 50")
def stream_project(spark, d):
    return _stream(spark).execute("SELECT sensor, v FROM readings WHERE v > 50")


@query(f"SELECT sensor, count(*) AS n, sum(v)::BIGINT AS total FROM ({_READINGS}) GROUP BY sensor")
def stream_running_total(spark, d):
    e, sink = _stream(spark), f"sink_{next(_sinks)}"
    e.start("SELECT sensor, COUNT(*) AS n, SUM(v) AS total FROM readings GROUP BY sensor EMIT CHANGES", sink)
    return spark.table(sink)


@query(f"SELECT sensor, v // 20 AS w, count(*) AS n FROM ({_READINGS}) WHERE v < 40 GROUP BY ALL")
def stream_emit_final(spark, d):
    """Only windows that the watermark (59 s) has closed."""
    e, sink = _stream(spark), f"sink_{next(_sinks)}"
    e.start("SELECT sensor, COUNT(*) AS n FROM readings WINDOW TUMBLING (SIZE 20 SECONDS) GROUP BY sensor EMIT FINAL", sink)
    return _numbered(spark.table(sink))


@query(f"SELECT sensor, v // 20 AS w, count(*) AS n FROM ({_READINGS}) GROUP BY ALL")
def stream_emit_changes(spark, d):
    e, sink = _stream(spark), f"sink_{next(_sinks)}"
    e.start("SELECT sensor, COUNT(*) AS n FROM readings WINDOW TUMBLING (SIZE 20 SECONDS) GROUP BY sensor EMIT CHANGES", sink)
    return _numbered(spark.table(sink))


def _numbered(df: DataFrame) -> DataFrame:
    return df.select("sensor", F.floor(F.unix_seconds("window_start") % 3600 / 20).alias("w"), "n")


@query(f"SELECT upper(sensor) AS sensor, v * 2 AS v FROM ({_READINGS}) WHERE v % 2 = 0")
def stream_insert_into(spark, d):
    """A continuous query into another stream, run twice over the same checkpoint: nothing is written twice."""
    e = _stream(spark)
    e.execute("CREATE STREAM even (sensor VARCHAR, v INTEGER)")
    for _ in range(2):
        e.insert_into("even", "SELECT upper(sensor) AS sensor, CAST(v * 2 AS INT) AS v FROM readings WHERE v % 2 = 0", f"{e.root}/checkpoint")
    return e.batch("even")


@query("SELECT 'STREAM_EXISTS' AS again, 'STREAM_NOT_FOUND' AS gone, 60::BIGINT AS n")
def stream_create_drop(spark, d):
    e = _stream(spark)
    n = e.batch("readings").count()
    again = _code(lambda: e.execute("CREATE STREAM readings (x INTEGER)"))
    e.execute("DROP STREAM readings")
    e.execute("DROP STREAM IF EXISTS readings")
    return spark.createDataFrame([(again, _code(lambda: e.batch("readings")), n)], "again string, gone string, n long")


@query("SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, o_orderdate::TIMESTAMP AS t, coalesce(o_orderdate::TIMESTAMP - lag(o_orderdate::TIMESTAMP) OVER w >= INTERVAL 30 DAY, true) AS fresh FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)) WHERE fresh GROUP BY 1")
def session_count(spark, d):
    """Sessions of customers, 30 days apart."""
    o = windows.event_time(read_table(spark, d, "orders"), "o_orderdate")
    out = windows.windowed(o, windows.session(30 * 86_400_000, "o_orderdate"), ["o_custkey"], [F.count("*").alias("c")])
    return out.groupBy("o_custkey").agg(F.count("*").alias("n"))


# --- documents -----------------------------------------------------------------------------


def _people(spark: SparkSession):
    c = DocumentStore(spark).collection("people")
    c.insert_many([
        {"_id": "a", "name": "Alice", "age": 30, "city": "Helsinki", "tags": ["java", "sql"]},
        {"_id": "b", "name": "Bob", "age": 25, "city": "Tampere", "tags": ["sql", "nosql"]},
        {"_id": "c", "name": "Cyd", "age": 35, "city": "Helsinki", "tags": ["nosql"]},
        {"_id": "d", "name": "Dee", "city": "Turku", "tags": []},
    ])
    return c


@query("SELECT * FROM (VALUES ('exists', 3::BIGINT), ('missing', 1), ('regex', 2), ('dsl', 1)) t(what, n)")
def doc_filters(spark, d):
    c = _people(spark)
    tests = {"exists": {"age": {"$exists": True}}, "missing": {"age": {"$exists": False}}, "regex": {"name": {"$regex": "^[AB]"}}, "dsl": Query.and_(Query.eq("city", "Helsinki"), Query.gt("age", 30))}
    return spark.createDataFrame([(k, c.count(q)) for k, q in tests.items()], "what string, n long")


@query("SELECT 'NOSQL_QUERY_ERROR' AS find, 'NOSQL_UPDATE_ERROR' AS change, 'ok' AS fine")
def doc_errors(spark, d):
    c = _people(spark)
    codes = _code(lambda: c.find({"age": {"$foo": 1}})), _code(lambda: c.update_many({}, {"$foo": {"a": 1}})), _code(lambda: c.find({"age": 1}))
    return spark.createDataFrame([codes], "find string, change string, fine string")


@query("""SELECT o_orderkey AS _id, least(o_totalprice, 150000.0) AS total, greatest(o_custkey, 700)::BIGINT AS cust, o_custkey * 3::BIGINT AS thrice, o_orderstatus AS state, o_orderstatus || ',x' AS tags, o_orderstatus AS once FROM orders""")
def doc_update_more(spark, d):
    """$min, $max, $mul, $rename, $push, $addToSet, $pull."""
    rows = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("_id"), F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("long").alias("cust"), F.col("o_custkey").cast("long").alias("thrice"), F.col("o_orderstatus").alias("status"),
        F.array("o_orderstatus").alias("tags"), F.array("o_orderstatus", F.lit("gone")).alias("once"),
    )
    change = {"$min": {"total": 150000.0}, "$max": {"cust": 700}, "$mul": {"thrice": 3}, "$rename": {"status": "state"}, "$push": {"tags": "x"}, "$pull": {"once": {"$eq": "gone"}}}
    out = compiler.apply_update(rows, F.lit(True), change)
    return compiler.apply_update(out, F.lit(True), {"$addToSet": {"tags": "x"}}).select("_id", "total", "cust", "thrice", "state", F.array_join("tags", ",").alias("tags"), F.array_join("once", ",").alias("once"))


@query("""SELECT o_orderstatus AS _id, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS kinds, max_by(o_orderkey, o_orderkey) AS last, count(*) AS pushed FROM orders GROUP BY o_orderstatus""")
def doc_accumulators(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("p"))
    group = {"_id": "$status", "mean": {"$avg": "$total"}, "low": {"$min": "$total"}, "kinds": {"$addToSet": "$p"}, "last": {"$last": "$_id"}, "pushed": {"$push": "$_id"}}
    out = compiler.pipeline(rows, [{"$group": group}])
    return out.select("_id", F.round("mean", 4).alias("mean"), "low", F.array_join(F.array_sort("kinds"), ",").alias("kinds"), "last", F.size("pushed").cast("long").alias("pushed"))


@query("SELECT * FROM (VALUES ('a', 31, 'java,sql,x'), ('b', 25, 'nosql'), ('e', NULL, NULL)) t(_id, age, tags)")
def doc_collection(spark, d):
    c = _people(spark)
    c.update_many({"city": "Helsinki"}, Update().inc("age", 1).push("tags", "x"))
    c.update_one({"_id": "b"}, Update().pull("tags", {"$eq": "sql"}).add_to_set("tags", "nosql"))
    c.delete_one({"_id": "c"})
    c.delete_many({"city": "Turku"})
    c.insert_one({"_id": "e", "name": "Eve"})
    c.replace_one({"_id": "e"}, {"name": "Eva"})
    return c.find().select("_id", F.col("age").cast("int").alias("age"), F.array_join("tags", ",").alias("tags"))


@query("SELECT * FROM (VALUES ('nosql', 2::BIGINT, 35), ('sql', 2, 30), ('java', 1, 30)) t(_id, n, oldest)")
def doc_pipeline_dsl(spark, d):
    c = _people(spark)
    out = c.aggregate(Pipeline().match({"age": {"$exists": True}}).unwind("$tags").group("$tags", n={"$sum": 1}, oldest={"$max": "$age"}).sort({"n": -1}))
    return out.select("_id", F.col("n").cast("long").alias("n"), F.col("oldest").cast("int").alias("oldest"))


@query("SELECT 4::BIGINT AS n, 3::BIGINT AS cities, 'DUPLICATE_KEY' AS again")
def doc_commands(spark, d):
    c = _people(spark)
    c.create_index("by_name", ["name"], unique=True)
    again = _code(lambda: c.insert_one({"name": "Bob"}))
    return spark.createDataFrame([(c.store.execute_command("people", {"count": {}}), c.distinct("city").count(), again)], "n long, cities long, again string")


def _cql(spark: SparkSession, d: str) -> CqlSession:
    s = CqlSession(spark)
    s.execute("CREATE KEYSPACE app WITH replication = {'class': 'SimpleStrategy'}")
    s.execute("USE app")
    s.execute("CREATE TABLE IF NOT EXISTS ev (id text, ts bigint, data text, n int, PRIMARY KEY ((id), ts))")
    put = s.prepare("INSERT INTO ev (id, ts, data, n) VALUES (?, ?, ?, ?)")
    for row in [("a", 1, "x", 1), ("a", 2, "y", 2), ("b", 1, "z", 3), ("a", 1, "new", 9)]:
        put(*row)
    return s


@query("SELECT * FROM (VALUES ('a', 1::BIGINT, 'new'), ('a', 2, 'y'), ('b', 1, 'z')) t(id, ts, data)")
def cql_select(spark, d):
    return _cql(spark, d).execute("SELECT id, ts, data FROM ev WHERE n >= 2 ALLOW FILTERING")


@query("SELECT * FROM (VALUES ('a', 2::BIGINT), ('b', 1)) t(id, n)")
def cql_count_distinct(spark, d):
    s = _cql(spark, d)
    ids = [r["id"] for r in s.execute("SELECT DISTINCT id FROM ev").collect()]
    return spark.createDataFrame([(i, s.execute(f"SELECT COUNT(*) FROM ev WHERE id = '{i}'").first()[0]) for i in ids], "id string, n long")


@query("SELECT * FROM (VALUES ('a', 'new'), ('b', 'q'), ('c', NULL)) t(id, data)")
def cql_batch(spark, d):
    s = _cql(spark, d)
    s.execute("BEGIN BATCH INSERT INTO ev (id, ts, n) VALUES ('c', 1, 1); UPDATE ev SET data = 'q' WHERE id = 'b'; DELETE FROM ev WHERE id = 'a' AND ts = 2; APPLY BATCH")
    return s.execute("SELECT id, data FROM ev")


@query("SELECT * FROM (VALUES ('a', 'new'), ('a', 'y'), ('b', NULL)) t(id, data)")
def cql_ttl_delete(spark, d):
    s = _cql(spark, d)
    s.execute("INSERT INTO ev (id, ts) VALUES ('t', 1) USING TTL 0")
    s.execute("UPDATE ev SET n = 0 WHERE id = 'a'")
    s.execute("DELETE data FROM ev WHERE id = 'b'")
    return s.execute("SELECT id, data FROM ev")


@query("SELECT 0::BIGINT AS left_rows, 'TABLE_NOT_FOUND' AS gone")
def cql_truncate_drop(spark, d):
    s = _cql(spark, d)
    s.execute("TRUNCATE ev")
    n = s.execute("SELECT count(*) FROM ev").first()[0]
    s.execute("DROP TABLE ev")
    return spark.createDataFrame([(n, _code(lambda: s.execute("SELECT * FROM ev")))], "left_rows long, gone string")


# --- extensions ----------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, o_totalprice * 2 AS a, o_totalprice + 1.5 AS b FROM orders")
def user_functions(spark, d):
    registry.define("doubled", lambda c: c * 2)
    registry.define_sql(spark, "more_by", "x DOUBLE, y DOUBLE", "DOUBLE", "x + y")
    price = F.col("o_totalprice")
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), registry.lookup("doubled", "oracle")(price).alias("a"), F.call_function("more_by", price, F.lit(1.5)).alias("b"))


@query("SELECT n_nationkey::INT AS id, n_regionkey * 3::INT AS x FROM nation")
def plugin_call(spark, d):
    class Thrice:
        name, order = "thrice", 1

        def register(self, context):
            context.call("mysql", "THRICE", lambda a: f"({a[0]} * 3)")

    plugins.load(Thrice())
    return _engine(spark, d, "mysql", nat=NATION).query("SELECT id, THRICE(region) AS x FROM nat")


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 8 ELSE -1 END AS x FROM orders")
def expression_tree(spark, d):
    tree = if_(op(">", var("o_totalprice"), lit(100000)), op("*", var("o_totalprice"), call("pow", lit(2.0), lit(3.0))), lit(-1.0))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), compile_column(tree).alias("x"))


@query("SELECT 3628800::BIGINT AS fact, 10::BIGINT AS total, -3::BIGINT AS quotient")
def script_tree(spark, d):
    fact = ("def", "f", ["n"], ("if", op("<", var("n"), lit(2)), lit(1), op("*", var("n"), call("f", op("-", var("n"), lit(1))))))
    step = ("assign", "i", op("+", var("i"), lit(1)))
    loop = ("block", ("assign", "s", lit(0)), ("for", ("assign", "i", lit(0)), op("<", var("i"), lit(5)), step, ("assign", "s", op("+", var("s"), var("i")))), ("return", var("s")))
    row = Script().run(("block", fact, call("f", lit(10)))), Script().run(loop), Script().run(op("/", lit(-7), lit(2)))
    return spark.createDataFrame([row], "fact long, total long, quotient long")


def queries() -> dict:
    """Name to query function."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(SQL)
