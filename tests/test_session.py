"""The engine session: DDL, DML, constraints, transactions, dialects."""

import pytest

from lumenmill.operators.dml import EngineError
from lumenmill.session import Engine


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def db(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE emp (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, dept INT, salary DOUBLE DEFAULT 10.0)")
    e.execute("INSERT INTO emp VALUES (1, 'Ann', 1, 100.0), (2, 'Bob', 1, 80.0), (3, 'Cid', 2, 90.0)")
    return e


def test_insert_update_delete(db):
    db.execute("INSERT INTO emp (id, name) VALUES (4, 'Dee')")
    db.execute("UPDATE emp SET salary = salary * 2, dept = 9 WHERE name LIKE 'A%'")
    db.execute("DELETE FROM emp WHERE id = 2")
    assert rows(db.query("SELECT id, dept, salary FROM emp WHERE dept IS NOT NULL")) == [(1, 9, 200.0), (3, 2, 90.0)]
    assert rows(db.query("SELECT salary FROM emp WHERE id = 4")) == [(10.0,)]
    db.execute("INSERT INTO emp SELECT id + 10, name, dept, salary FROM emp WHERE id < 4")
    assert db.table("emp").count() == 5


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("INSERT INTO emp VALUES (1, 'x', 1, 1.0)", "UNIQUE_VIOLATION"),
        ("INSERT INTO emp VALUES (9, NULL, 1, 1.0)", "NOT_NULL_VIOLATION"),
        ("UPDATE emp SET id = 7", "UNIQUE_VIOLATION"),
        ("INSERT INTO nope VALUES (1)", "TABLE_NOT_FOUND"),
        ("CREATE TABLE emp (id INT)", "TABLE_EXISTS"),
    ],
)
def test_errors_leave_the_table(db, text, code):
    with pytest.raises(EngineError) as e:
        db.execute(text)
    assert e.value.error_code == code
    assert db.table("emp").count() == 3


def test_foreign_key_and_check(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE parent_t (id INT PRIMARY KEY)")
    e.execute("CREATE TABLE child_t (id INT, parent_id INT REFERENCES parent_t(id), n INT CHECK (n > 0))")
    e.execute("INSERT INTO parent_t VALUES (1)")
    e.execute("INSERT INTO child_t VALUES (1, 1, 5), (2, NULL, 1)")
    for text, code in (("INSERT INTO child_t VALUES (3, 2, 1)", "FOREIGN_KEY_VIOLATION"), ("INSERT INTO child_t VALUES (3, 1, 0)", "CHECK_VIOLATION"), ("DELETE FROM parent_t WHERE id = 1", "FOREIGN_KEY_VIOLATION")):
        with pytest.raises(EngineError) as err:
            e.execute(text)
        assert err.value.error_code == code


def test_transactions(db):
    db.script("BEGIN; UPDATE emp SET salary = 0; SAVEPOINT a; DELETE FROM emp; ROLLBACK TO a")
    assert rows(db.query("SELECT count(*), sum(salary) FROM emp")) == [(3, 0.0)]
    db.execute("ROLLBACK")
    assert rows(db.query("SELECT sum(salary) FROM emp")) == [(270.0,)]
    db.script("BEGIN; DELETE FROM emp WHERE id = 1; COMMIT")
    assert db.table("emp").count() == 2


def test_merge(spark):
    e = Engine(spark)
    e.script("CREATE TABLE target_m (id INT, name STRING, value INT); INSERT INTO target_m VALUES (1,'a',10),(2,'b',20),(3,'c',30)")
    e.script("CREATE TABLE source_m (id INT, name STRING, value INT); INSERT INTO source_m VALUES (2,'B',200),(3,'C',300),(4,'D',400)")
    e.execute("MERGE INTO target_m t USING source_m s ON t.id = s.id WHEN MATCHED THEN UPDATE SET name = s.name, value = t.value + s.value WHEN NOT MATCHED THEN INSERT (id, name, value) VALUES (s.id, s.name, s.value)")
    assert rows(e.table("target_m")) == [(1, "a", 10), (2, "B", 220), (3, "C", 330), (4, "D", 400)]
    e.execute("MERGE INTO target_m t USING source_m s ON t.id = s.id WHEN MATCHED THEN DELETE")
    assert rows(e.table("target_m")) == [(1, "a", 10)]


def test_alter_view_index_trigger_procedure(db):
    db.execute("ALTER TABLE emp ADD COLUMN state VARCHAR(5) DEFAULT 'on'")
    db.execute("ALTER TABLE emp RENAME COLUMN state TO status")
    db.execute("CREATE VIEW rich AS SELECT id, status FROM emp WHERE salary > 85")
    db.execute("CREATE INDEX ix ON emp (dept)")
    db.execute("CREATE TABLE audit_t (what STRING)")
    db.execute("CREATE TRIGGER tr AFTER DELETE ON emp INSERT INTO audit_t VALUES ('gone')")
    db.execute("CREATE PROCEDURE cut() AS BEGIN DELETE FROM emp WHERE id = 3; SELECT count(*) AS n FROM emp; END")
    assert rows(db.execute("CALL cut()")) == [(2,)]
    assert rows(db.query("SELECT * FROM rich")) == [(1, "on")]
    assert rows(db.table("audit_t")) == [("gone",)]
    db.execute("ALTER TABLE emp DROP COLUMN status")
    db.execute("DROP TABLE audit_t")
    with pytest.raises(EngineError):
        db.table("audit_t")


def test_batch_and_identity(spark):
    e = Engine(spark, "postgresql")
    e.execute("CREATE TABLE item_t (id SERIAL PRIMARY KEY, name TEXT, price DOUBLE)")
    got = e.execute("INSERT INTO item_t (name, price) VALUES ('a', 1.5) RETURNING id, name")
    assert rows(got) == [(1, "a")]
    assert e.insert_batch("item_t", ["name", "price"], [(f"n{i}", float(i)) for i in range(1000)]) == 1000
    assert rows(e.query("SELECT count(*), max(id), count(DISTINCT id) FROM item_t")) == [(1001, 1001, 1001)]


def test_postgres(spark):
    e = Engine(spark, "postgresql")
    e.execute("CREATE TABLE users_p (id INT PRIMARY KEY, name TEXT, n INT)")
    e.execute("INSERT INTO users_p VALUES (1, 'a', 1), (2, 'b', 1)")
    e.execute("INSERT INTO users_p VALUES (1, 'x', 5), (3, 'c', 1) ON CONFLICT (id) DO NOTHING")
    e.execute("INSERT INTO users_p VALUES (2, 'z', 5) ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, n = n + EXCLUDED.n")
    assert rows(e.table("users_p")) == [(1, "a", 1), (2, "z", 6), (3, "c", 1)]
    assert rows(e.query("SELECT DISTINCT ON (n) n, id FROM users_p ORDER BY n, id DESC")) == [(1, 3), (6, 2)]
    assert rows(e.query("SELECT id FROM users_p WHERE name SIMILAR TO '(a|z)%'")) == [(1,), (2,)]
    assert rows(e.query("SELECT '42'::int AS a, regexp_replace('aXbX', 'X', '-') AS b, array_length(ARRAY[1,2], 1) AS c")) == [(42, "a-bX", 2)]
    assert rows(e.execute("UPDATE users_p SET n = 0 WHERE id = 1 RETURNING id, n")) == [(1, 0)]
    assert rows(e.execute("DO $$ BEGIN DELETE FROM users_p WHERE id = 1; SELECT count(*) AS c FROM users_p; END $$")) == [(2,)]


def test_oracle(spark):
    e = Engine(spark, "oracle")
    e.execute("CREATE TABLE org_t (id INT, name VARCHAR2, parent_id INT)".replace("VARCHAR2", "VARCHAR"))
    e.execute("INSERT INTO org_t VALUES (1,'root',NULL),(2,'a',1),(3,'b',1),(4,'c',2),(5,'d',4),(6,'e',3)")
    got = e.query("SELECT id, LEVEL FROM org_t START WITH parent_id IS NULL CONNECT BY PRIOR id = parent_id")
    assert rows(got) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 3)]
    assert rows(e.query("SELECT id FROM org_t WHERE ROWNUM <= 2")).__len__() == 2
    assert rows(e.query("SELECT NVL(NULL, 'x') AS a, NVL2(NULL, 1, 2) AS b, DECODE(2, 1, 'one', 2, 'two', 'many') AS c, TO_NUMBER('1.5') AS d FROM DUAL")) == [("x", 2, "two", 1.5)]
    e.execute("CREATE SEQUENCE sq START WITH 5 INCREMENT BY 10")
    assert [e.query("SELECT sq.NEXTVAL AS v FROM DUAL").first()[0] for _ in range(2)] == [5, 15]
    assert e.query("SELECT sq.CURRVAL AS v FROM DUAL").first()[0] == 15
    assert e.query("SELECT MONTHS_BETWEEN(DATE'2024-03-15', DATE'2024-01-15') AS m FROM DUAL").first()[0] == 2.0


def test_mssql(spark):
    e = Engine(spark, "mssql")
    e.execute("CREATE TABLE prod_t (id INT PRIMARY KEY, name VARCHAR(10), price DOUBLE)")
    got = e.execute("INSERT INTO prod_t (id, name, price) OUTPUT INSERTED.id VALUES (1, 'a', 5.0)")
    assert rows(got) == [(1,)]
    e.execute("INSERT INTO prod_t VALUES (2, 'b', 7.0), (3, 'c', 7.0), (4, 'd', 9.0)")
    assert len(rows(e.query("SELECT TOP 2 id FROM prod_t WITH (NOLOCK) ORDER BY price DESC"))) == 2
    assert rows(e.query("SELECT TOP 50 PERCENT id FROM prod_t ORDER BY price DESC, id")) == [(2,), (4,)]
    assert rows(e.query("SELECT TOP 2 WITH TIES id, price FROM prod_t ORDER BY price DESC")) == [(2, 7.0), (3, 7.0), (4, 9.0)]
    e.execute("DECLARE @x INT = 5")
    e.execute("SET @x = @x + 1")
    assert rows(e.query("SELECT @x AS x, ISNULL(NULL, 3) AS y, CHARINDEX('b', 'abc') AS z, STUFF('abcdef', 2, 3, 'X') AS s")) == [(6, 3, 2, "aXef")]
    assert rows(e.query("SELECT CONVERT(INT, '12') AS a, DATEDIFF(DAY, '2024-01-01', '2024-01-31') AS b, FORMAT(1234.5, 'N2') AS c")) == [(12, 30, "1,234.50")]
    got = e.execute("BEGIN TRY INSERT INTO prod_t VALUES (1, 'dup', 1.0) END TRY BEGIN CATCH SELECT 'failed' AS r END CATCH")
    assert rows(got) == [("failed",)]


def test_mysql(spark):
    e = Engine(spark, "mysql")
    e.execute("CREATE TABLE users_m (id INT PRIMARY KEY, name VARCHAR(10), hits INT)")
    e.execute("INSERT INTO users_m VALUES (1, 'a', 1), (2, 'b', 1)")
    e.execute("REPLACE INTO users_m VALUES (2, 'B', 7), (3, 'c', 1)")
    e.execute("INSERT INTO users_m VALUES (1, 'z', 4) ON DUPLICATE KEY UPDATE hits = hits + VALUES(hits)")
    assert rows(e.table("users_m")) == [(1, "a", 5), (2, "B", 7), (3, "c", 1)]
    assert rows(e.query("SELECT `id` FROM users_m ORDER BY id LIMIT 1, 2")) == [(2,), (3,)]
    assert rows(e.query("SELECT FIELD('b', 'a', 'b') AS f, FIND_IN_SET('c', 'a, b, c') AS g, LOCATE('z', 'abc') AS l, IFNULL(NULL, 1) AS i, DATE_FORMAT(DATE'2024-02-03', '%d/%m/%Y') AS d")) == [(2, 3, 0, 1, "03/02/2024")]
    assert "users_m" in [r[1] for r in e.query("SHOW TABLES").collect()]


def test_special_engines(spark):
    e = Engine(spark)
    e.put("locations_s", spark.sql("SELECT id, named_struct('x', x, 'y', y) AS pos FROM VALUES (1, 0D, 0D), (2, 3D, 4D), (3, 6D, 8D) t(id, x, y)"))
    assert rows(e.query("SELECT id, ST_DISTANCE(pos, POINT(0, 0)) AS distance FROM locations_s")) == [(1, 0.0), (2, 5.0), (3, 10.0)]
    assert rows(e.query("SELECT id FROM locations_s WHERE ST_WITHIN(pos, 0, 0, 5)")) == [(1,), (2,)]
    e.put("docs_s", spark.createDataFrame([(1, "The quick brown fox"), (2, "lazy dog"), (3, "brown bread's")], "id int, content string"))
    assert rows(e.query("SELECT id FROM docs_s WHERE MATCH(content) AGAINST('brown')")) == [(1,), (3,)]
    assert rows(e.query("SELECT id FROM docs_s WHERE MATCH(content) AGAINST('+brown -fox' IN BOOLEAN MODE)")) == [(3,)]
    assert rows(e.query("SELECT id, MATCH(content) AGAINST('brown fox') AS relevance FROM docs_s WHERE id < 3")) == [(1, 2), (2, 0)]
    e.put("temps_s", spark.sql("SELECT timestamp(a) AS ts, v FROM VALUES ('2024-01-01 10:00', 1D), ('2024-01-01 10:30', 3D), ('2024-01-01 11:00', 5D), ('2024-01-01 11:30', 9D) t(a, v)"))
    assert [r[1] for r in rows(e.query("SELECT time_bucket('1h', ts) AS b, avg(v) AS m FROM temps_s GROUP BY 1"))] == [2.0, 7.0]


def test_apply_and_series(spark):
    e = Engine(spark, "mssql")
    e.put("dep_a", spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string"))
    e.put("emp_a", spark.createDataFrame([(1, 10), (1, 20)], "dep int, pay int"))
    assert rows(e.query("SELECT d.id, t.pay FROM dep_a d CROSS APPLY (SELECT pay FROM emp_a e WHERE e.dep = d.id) t")) == [(1, 10), (1, 20)]
    assert sorted(map(str, rows(e.query("SELECT d.id, t.total FROM dep_a d OUTER APPLY (SELECT sum(pay) AS total FROM emp_a e WHERE e.dep = d.id) AS t")))) == ["(1, 30)", "(2, None)"]
    p = Engine(spark, "postgresql")
    assert rows(p.query("SELECT generate_series FROM generate_series(1, 7, 3)")) == [(1,), (4,), (7,)]


def test_plugins(spark):
    from lumenmill import plugins

    class Extra:
        name, order = "extra", 5

        def register(self, context):
            context.statement(r"HELLO (\w+)", lambda engine, m, text, args: engine.spark.sql(f"SELECT '{m[1]}' AS who"))
            context.call("mysql", "TWICE", lambda a: f"({a[0]} * 2)")

    assert "extra" in plugins.load(Extra(), Extra())
    e = Engine(spark, "mysql")
    assert rows(e.execute("HELLO world")) == [("world",)]
    assert rows(e.query("SELECT TWICE(4 + 1) AS x")) == [(10,)]


def test_plans_are_cut(spark):
    """Changes don't pile up in a table's plan."""
    e = Engine(spark)
    e.execute("CREATE TABLE grow_t (id INT PRIMARY KEY)")
    sizes = []
    for i in range(40):
        e.execute(f"INSERT INTO grow_t VALUES ({i})")
        sizes.append(len(e.table("grow_t")._jdf.queryExecution().logical().toString()))
    assert max(sizes[16:]) <= 1.5 * max(sizes[:16]) and e.table("grow_t").count() == 40
    with pytest.raises(EngineError, match="UNIQUE_VIOLATION"):
        e.execute("INSERT INTO grow_t VALUES (3)")


def test_rollback_over_a_cut(spark):
    e = Engine(spark)
    e.script("CREATE TABLE back_t (id INT); INSERT INTO back_t VALUES (1); BEGIN")
    for i in range(20):
        e.execute(f"INSERT INTO back_t VALUES ({i})")
    e.execute("ROLLBACK")
    assert rows(e.table("back_t")) == [(1,)]


def test_names_belong_to_an_engine(spark):
    a, b = Engine(spark), Engine(spark)
    a.script("CREATE TABLE zz (id INT); INSERT INTO zz VALUES (1); CREATE VIEW vv AS SELECT id FROM zz")
    b.script("CREATE TABLE zz (id INT); INSERT INTO zz VALUES (2)")
    assert [rows(e.query("SELECT * FROM zz")) for e in (a, b, a)] == [[(1,)], [(2,)], [(1,)]]
    assert rows(a.query("SELECT * FROM vv")) == rows(a.table("vv")) == [(1,)]
    assert [r["tableName"] for r in b.query("SHOW TABLES").collect()] == ["zz"]


def test_merge_with_identity_and_defaults(spark):
    e = Engine(spark, "postgresql")
    e.script("CREATE TABLE mid_t (id SERIAL PRIMARY KEY, k INT, v INT DEFAULT 7); INSERT INTO mid_t (k, v) VALUES (1, 1), (2, 2)")
    e.execute("MERGE INTO mid_t t USING (VALUES (2, 20), (3, 30), (4, 40)) AS s (k, v) ON t.k = s.k WHEN MATCHED AND s.v = 20 THEN UPDATE SET v = s.v + t.v WHEN NOT MATCHED AND s.k = 3 THEN INSERT (k) VALUES (s.k) WHEN NOT MATCHED THEN INSERT (k, v) VALUES (k, v)")
    assert rows(e.query("SELECT k, v FROM mid_t")) == [(1, 1), (2, 22), (3, 7), (4, 40)]
    assert e.query("SELECT count(DISTINCT id) AS n, max(id) AS m FROM mid_t").first()[:] == (4, 4)
