"""Every registered query of the engine's own operators against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from lumenmill.plans import catalog
from lumenmill.sources.tables import TABLES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([norm(r[k]) for k in at]) for r in rel.fetchall())


def test_pushdown_and_pruning(spark):
    plan = catalog.queries()["tpch_q6"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(" in plan
    assert "ReadSchema: struct<l_quantity" in plan and "l_orderkey" not in plan


def differ(spark, tmp_path, name, table, select):
    """Rows of a query and of its SQL over a table of its own."""
    duckdb.sql(f"COPY ({select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = catalog.queries()[name](spark, str(tmp_path))
    rel = c.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})")
    return sorted(map(tuple, got.collect()), key=repr), sorted(rel.fetchall(), key=repr)


def test_sliding_by_rounded_milliseconds(spark, tmp_path):
    # halves of a millisecond on both sides of 1970, an hour apart or nearly so, copies, no time and no type
    parts = "range(0, 3) h(h), (VALUES (0), (1), (499), (500), (501), (999), (1500), (3599999500), (3599999499), (1800000000)) u(u), (VALUES (-1), (0), (1)) d(d)"
    made = f"SELECT make_timestamp((h - 1) * 3600000000 + u * (1 - 2 * (h % 2)) + d) AS ts FROM {parts} UNION ALL SELECT ts FROM (VALUES (NULL::TIMESTAMP), (NULL)) n(ts)"
    got, want = differ(spark, tmp_path, "win_sliding", "events", f"SELECT row_number() OVER () AS event_id, ts, CASE row_number() OVER () % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS event_type FROM ({made})")
    assert got == want and len(got) == 92


def test_null_safe_join_counts_before_it_meets(spark, tmp_path):
    # 6000 x 6000 pairs of one key and 2000 x 2000 of null are counted, not made; then keys that don't meet
    for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")):
        spark.range(8_000).selectExpr(f"CAST(IF(id < 2000, IF(id % 2 = 0, 3, NULL), 7) AS INT) AS {c}").write.parquet(f"{tmp_path}/a/{t}.parquet")
        spark.range(2).selectExpr(f"CAST({1 if t == 'customer' else 2} AS INT) AS {c}").write.parquet(f"{tmp_path}/b/{t}.parquet")
    query = catalog.queries()["join_null_safe"]
    found = query(spark, f"{tmp_path}/a")
    assert found.dtypes == [("n", "bigint")] and found.collect() == [(6_000**2 + 2_000**2,)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert below.count("Aggregate [") == 2  # one on each side of the join
    assert query(spark, f"{tmp_path}/b").collect() == [(0,)]
