"""Operators and compatibility forms on nulls, ties and empty inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenmill.functions import core
from lumenmill.operators import columnar, fulltext, olap, relational, spatial, timeseries
from lumenmill.operators.dml import EngineError
from lumenmill.sources.tables import read_any, write_any


def vals(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def emp(spark):
    rows = [(1, "Alice", "Eng", 90), (2, "Bob", "Eng", 85), (3, "Carol", "Eng", 85), (4, "Dave", "Sales", 70), (5, "Eve", "Sales", 75), (6, "Frank", "Sales", 65), (7, "Grace", "HR", 80), (8, "Heidi", "HR", None)]
    return spark.createDataFrame(rows, "id int, name string, dept string, salary int")


def test_limits(emp):
    assert vals(relational.distinct_on(emp, ["dept"], [F.col("salary").desc_nulls_last()]), "id") == [(1,), (5,), (7,)]
    assert vals(relational.top(emp, 2, [F.desc("salary")], ties=True), "id") == [(1,), (2,), (3,)]
    assert vals(relational.top(emp, 30, [F.asc("id")], percent=True), "id") == [(1,), (2,), (3,)]
    assert relational.top(emp.limit(0), 5, [F.asc("id")], percent=True).count() == 0
    assert relational.top(emp.limit(0), 5, [F.asc("id")], ties=True).count() == 0
    assert [r[0] for r in relational.generate_series(emp.sparkSession, 5, 1, -2).collect()] == [5, 3, 1]
    with pytest.raises(ValueError):
        relational.generate_series(emp.sparkSession, 1, 2, 0)


def test_grouping_and_pivot(spark, emp):
    assert olap.rollup_sets(["a", "b"]) == [("a", "b"), ("a",), ()]
    assert len(olap.cube_sets(["a", "b", "c"])) == 8
    got = olap.grouping_sets(emp, [("dept",), ()], [F.sum("salary").alias("s")])
    assert vals(got, "dept", "s") == [("Eng", 260), ("HR", 80), ("Sales", 210), (None, 550)]
    sales = spark.createDataFrame([("A", 1, 10), ("A", 2, None), ("B", 1, 5)], "p string, q int, v int")
    assert vals(olap.pivot(sales, ["p"], "q", [1, 2], "COUNT", "v"), "p", "1", "2") == [("A", 1, None), ("B", 1, None)]
    assert vals(olap.unpivot(sales, ["p"], ["q", "v"], "n", "x"), "p", "n", "x") == [("A", "q", 1), ("A", "q", 2), ("A", "v", 10), ("B", "q", 1), ("B", "v", 5)]


def test_hierarchy_cuts_cycles(spark):
    t = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4)], "id int, parent int")
    assert vals(olap.connect_by(t, "id", "parent", F.col("id") == 1), "id", "level") == [(1, 1), (2, 2), (3, 3)]
    assert vals(olap.connect_by(t, "id", "parent", F.col("parent").isNull()), "id", "level") == [(4, 1), (5, 2)]


def test_window_compatibility(emp):
    order = [F.col("salary").desc_nulls_last(), F.asc("id")]
    ten = emp.sparkSession.range(10)
    assert vals(ten.withColumn("b", core.ntile(4, [], [F.asc("id")])).groupBy("b").count(), "b", "count") == [(1, 3), (2, 2), (3, 3), (4, 2)]
    ties = emp.where("dept = 'Eng'").withColumn("run", F.sum("salary").over(core.rows_frame([F.col("dept")], order)))
    assert vals(ties, "id", "run") == [(1, 90), (2, 175), (3, 260)]
    counted = emp.withColumn("n", core.count_rows(W.partitionBy("dept"))).where("dept = 'HR'")
    assert vals(counted, "id", "n") == [(7, 2), (8, 2)]
    assert emp.limit(0).agg(core.sum_or_zero(F.col("salary")).alias("s")).first()["s"] == 0
    assert vals(emp.withColumn("m", F.avg("id").over(olap.moving(["dept"], [F.asc("id")], 1, 1))).where("id = 2"), "m") == [(2.0,)]


def test_null_keys_in_joins(spark):
    a, b = spark.createDataFrame([(1, None), (2, 5)], "i int, k int"), spark.createDataFrame([(None, "n"), (5, "f")], "k2 int, v string")
    assert vals(a.join(b, core.eq(F.col("k"), F.col("k2"))), "i", "v") == [(1, "n"), (2, "f")]
    assert vals(a.join(b, F.col("k") == F.col("k2")), "i", "v") == [(2, "f")]


def test_time_series(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    t = spark.createDataFrame([(at(10, 0), 1.0, "a"), (at(10, 30), 3.0, "a"), (at(13, 0), 5.0, "a"), (None, 9.0, "a")], "ts timestamp, v double, k string")
    b = timeseries.time_bucket(t, "1h", "v", keys=["k"])
    assert vals(b, "bucket", "n", "sum", "first", "last") == [(at(10, 0), 2, 4.0, 1.0, 3.0), (at(13, 0), 1, 5.0, 5.0, 5.0)]
    assert vals(timeseries.gap_fill(b.select("k", "bucket", "sum"), "1h", ["k"], ["sum"]), "bucket", "sum") == [(at(10, 0), 4.0), (at(11, 0), 4.0), (at(12, 0), 4.0), (at(13, 0), 5.0)]
    assert timeseries.retain(t, "2h", F.lit("2024-01-01 14:00").cast("timestamp")).count() == 1
    with pytest.raises(ValueError):
        timeseries.seconds_of("soon")


def test_runs(spark):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(["x", "x", None, None, "x", "y"])], "i int, v string")
    runs = columnar.run_length_encode(t.withColumn("p", F.lit(0)), ["p"], [F.asc("i")], "v")
    assert vals(runs, "run", "value", "length") == [(1, "x", 2), (2, None, 2), (3, "x", 1), (4, "y", 1)]
    assert columnar.run_length_decode(runs, ["p"]).count() == 6
    assert columnar.column_aggregate(t.limit(0), "max", "i").first()[0] == 0.0


def test_text_and_space(spark):
    d = spark.createDataFrame([(1, "The quick brown fox"), (2, "lazy dog"), (3, "Brown bread"), (4, None)], "id int, t string")
    index = fulltext.build_index(d, "id", ["t"])
    for idx in (None, index):
        got = {r["id"]: r["relevance"] for r in fulltext.match_any(d, "id", ["t"], "brown fox!", idx).collect()}
        assert set(got) == {1, 3} and got[1] > got[3]
    assert vals(fulltext.match_boolean(d, ["t"], '"lazy dog" -cat'), "id") == [(2,)]
    p = spark.createDataFrame([(1, "POINT(0, 0)"), (2, "point(3 4)"), (3, "nowhere")], "id int, w string").withColumn("p", spatial.parse_point(F.col("w")))
    assert vals(p.select("id", spatial.st_distance(F.col("p"), spatial.point(0, 0)).alias("d")), "id", "d") == [(1, 0.0), (2, 5.0), (3, None)]
    assert vals(p.where(spatial.st_contains(spatial.point(-1, -1), spatial.point(1, 1), F.col("p"))), "id") == [(1,)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    write_any(df, fmt, f"{tmp_path}/{fmt}", partition_by=("k",))
    assert vals(read_any(spark, fmt, f"{tmp_path}/{fmt}", "id int, k string"), "id", "k") == [(1, "a"), (2, "b")]


def test_gap_fill_of_a_null_key(spark):
    rows = [(None, "2024-01-01 00:00", 5), (None, "2024-01-01 02:00", 7), ("a", "2024-01-01 01:00", 1)]
    df = spark.createDataFrame(rows, "k string, t string, n int").selectExpr("k", "timestamp(t) AS bucket", "n")
    got = timeseries.gap_fill(df, "1h", ["k"], ["n"]).orderBy("k", "bucket").collect()
    assert [(r["k"], r["n"]) for r in got] == [(None, 5), (None, 5), (None, 7), ("a", 1)]


def test_depth_limits_are_errors(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id int, up int")
    assert olap.connect_by(chain, "id", "up", F.col("up").isNull()).count() == 12
    with pytest.raises(EngineError, match="RECURSION_LIMIT"):
        olap.connect_by(chain, "id", "up", F.col("up").isNull(), max_depth=5)
    grow = lambda df: df.select((F.col("id") + 1).alias("id"))
    with pytest.raises(EngineError, match="RECURSION_LIMIT"):
        olap.recursive_fixpoint(spark.range(1), grow, max_rounds=3)


def test_distance_join_of_crowded_cells(spark, monkeypatch):
    # copies, neighbours at the radius whose quotients lie two apart, points without a place and at the end of the numbers
    inf = float("inf")
    rows = [(i, (i % 3) * 0.1, (i % 7) * 0.05) for i in range(90)] + [(90, -5e-324, 7.0), (91, 0.1, 7.0), (92, None, 1.0), (93, float("nan"), 1.0), (94, inf, 1.0), (95, 1e300, 1.0), (96, 1e300, 1.0)]
    p = spark.createDataFrame(rows, "i int, x double, y double").select("i", spatial.point(F.col("x"), F.col("y")).alias("p"))
    near = lambda a, b: math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])) <= 0.1
    want = sorted((a[0], b[0]) for a in rows for b in rows if None not in a + b and near(a, b))
    monkeypatch.setattr(spatial, "_BLOCK", 4, raising=False)
    monkeypatch.setattr(spatial, "_SHARE", 100, raising=False)
    got = spatial.distance_join(p.toDF("a", "pa"), p.toDF("b", "pb"), "pa", "pb", 0.1)
    assert got.columns == ["a", "pa", "b", "pb"]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and (90, 91) in want
    assert got.rdd.getNumPartitions() > 4  # by the candidates, not the rows


def test_distance_join_broadcasts_no_side(spark):
    p = spark.range(5).select("id", spatial.point(F.col("id"), F.col("id")).alias("p"))  # Spark knows that it is small
    plan = spatial.distance_join(p.toDF("a", "pa"), p.toDF("b", "pb"), "pa", "pb", 0.1)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "SortMergeJoin [_cx" in joins[0] and "POWER" in joins[0]
    assert all("LeftOuter" in line for line in joins if "BroadcastHashJoin" in line)  # the crowded cells, counted
