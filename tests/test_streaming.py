"""Windows and joins: batch and streaming runs of the same plan agree."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenmill.operators.dml import EngineError
from lumenmill.streaming import windows
from lumenmill.streaming.engine import StreamEngine


def at(s):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)


@pytest.fixture
def engine(spark, tmp_path):
    e = StreamEngine(spark, f"file://{tmp_path}/s")
    e.execute("CREATE STREAM sensors (sensor VARCHAR, temp DOUBLE, ts TIMESTAMP) WITH (kafka_topic='t')")
    return e


def test_tumbling_sql(engine):
    engine.ingest("sensors", [("a", 20.0 + k, at(1 + 2 * k)) for k in range(5)])
    r = engine.execute("SELECT sensor, AVG(temp) AS m, COUNT(*) AS n FROM sensors WINDOW TUMBLING (SIZE 10 SECONDS) WHERE temp > 0 GROUP BY sensor").first()
    assert (r["m"], r["n"]) == (22.0, 5)
    assert engine.streams["sensors"].properties == {"kafka_topic": "t"}


@pytest.mark.parametrize("window", ["TUMBLING (SIZE 10 SECONDS)", "HOPPING (SIZE 30 SECONDS, ADVANCE 10 SECONDS)", "SESSION (GAP 5 SECONDS)"])
def test_stream_equals_batch(engine, spark, window):
    name = "sink_" + window[:7].lower()
    text = f"SELECT sensor, COUNT(*) AS n, SUM(temp) AS s FROM sensors WINDOW {window} GROUP BY sensor"
    engine.ingest("sensors", [("a", float(k), at(2 * k)) for k in range(15)] + [("b", 1.0, at(3)), ("b", 2.0, at(60))])
    engine.start(text + " EMIT FINAL", name, lateness="0 seconds")
    got = {tuple(r) for r in spark.table(name).collect()}
    want = {tuple(r) for r in engine.execute(text).collect()}
    assert got <= want and got
    assert all(r[1] > at(40).replace(tzinfo=None) for r in want - got)  # only windows the watermark has not closed
    if "SESSION" not in window:
        engine.start(text + " EMIT CHANGES", name + "_c")
        assert {tuple(r) for r in spark.table(name + "_c").collect()} == want


def test_session_gap_boundary(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(9))], "k int, ts timestamp")
    assert [r["n"] for r in windows.windowed(df, windows.session(5000), ["k"], [F.count("*").alias("n")]).orderBy("window_start").collect()] == [1, 2]


def test_sliding(spark, engine):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", at(i)) for i in range(20)], "id int, k string, ts timestamp")
    got = windows.sliding_grouped(df, 5000, "id", ["k"], [F.count("*").alias("n")])
    rows = {(r["anchor"], r["k"]): r["n"] for r in got.collect()}
    want = {}
    for i in range(20):
        for j in range(max(0, i - 4), i + 1):
            key = (i, "a" if j % 2 else "b")
            want[key] = want.get(key, 0) + 1
    assert rows == want
    one = windows.sliding(df, 5000, ["k"], {"n": F.count(F.lit(1))})
    assert {r["id"]: r["n"] for r in one.collect()} == {i: min(i // 2 + 1, 3) for i in range(20)}


def test_joins_and_lateness(spark):
    a = spark.createDataFrame([(1, "x", at(0)), (2, "y", at(10))], "k int, v string, ts timestamp")
    b = spark.createDataFrame([(1, "p", at(4)), (2, "q", at(30))], "k int, w string, ts timestamp")
    assert [(r["k"], r["right_w"], r["joined_ts"]) for r in windows.stream_join(a, b, "k", 5000).collect()] == [(1, "p", at(4).replace(tzinfo=None))]
    assert {tuple(r) for r in windows.lookup_join(a, spark.createDataFrame([(1, "new")], "k int, v string"), "k").select("k", "v").collect()} == {(1, "new")}
    late = spark.createDataFrame([(0, at(10)), (1, at(9)), (2, at(8.999))], "i int, ts timestamp")
    assert [r["i"] for r in windows.late_filter(late, 1000, ["i"]).collect()] == [0, 1]


def test_stream_into_stream_and_drop(engine, tmp_path):
    engine.execute("CREATE STREAM hot (sensor VARCHAR, temp DOUBLE)")
    engine.ingest("sensors", [("a", 50.0, at(1)), ("b", 10.0, at(2))])
    engine.insert_into("hot", "SELECT sensor, temp FROM sensors WHERE temp > 20", f"file://{tmp_path}/cp")
    assert [tuple(r) for r in engine.batch("hot").collect()] == [("a", 50.0)]
    engine.execute("DROP STREAM hot")
    with pytest.raises(EngineError):
        engine.execute("SELECT * FROM hot")
    with pytest.raises(EngineError):
        engine.execute("CREATE STREAM sensors (a INT)")


def test_session_gap_in_microseconds(spark):
    near = [(1, at(0)), (1, at(0) + dt.timedelta(microseconds=4_999_500)), (1, at(60)), (1, at(65))]
    df = spark.createDataFrame(near, "k int, ts timestamp")
    got = windows.windowed(df, windows.session(5000), ["k"], [F.count("*").alias("n")]).orderBy("window_start").collect()
    assert [r["n"] for r in got] == [2, 1, 1]


def test_sliding_to_the_microsecond(spark):
    us = lambda n: at(0) + dt.timedelta(microseconds=n)
    # 400 is not in the window of 5_000_400 but in that of 5_000_399; 5_000_500 is not yet seen from 5_000_400; a name is shared
    times = [400, 700, 5_000_399, 5_000_400, 5_000_500, 5_000_500, 10_000_000, None]
    rows = [(min(i, 6), ["a", None, "b"][i % 3], None if i == 2 else i * 0.5, None if t is None else us(t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id int, k string, v double, ts timestamp")
    texts = ["count(*) AS n", "COUNT ( v ) AS c", "sum(v) AS s", "AVG(v) AS m", "min(v)", "max(id + 1) AS h"]
    want = {}
    for i, (_, _, _, ts) in enumerate(rows):
        for other in rows if ts else []:
            if other[3] and ts - dt.timedelta(seconds=5) < other[3] <= ts:
                want.setdefault((rows[i][0], other[1]), []).append(other)
    value = lambda found, f: f(v) if (v := [r[2] for r in found if r[2] is not None]) else None
    want = {k: (len(f), value(f, len) or 0, value(f, sum), value(f, lambda v: sum(v) / len(v)), value(f, min), max(r[0] for r in f) + 1) for k, f in want.items()}
    found = lambda df: {(r[0], r[1]): tuple(r[2:]) for r in df.collect()}
    plain = windows.sliding_grouped(df, 5000, "id", ["k"], [F.expr(t) for t in texts])
    assert found(plain) == want
    quick = windows.sliding_grouped(df, 5000, "id", ["k"], texts)
    assert quick.dtypes == plain.dtypes and found(quick) == want
    one = windows.sliding(df.where("id < 5"), 5000, [], {"n": F.count(F.lit(1))})
    assert [r["n"] for r in one.orderBy("ts").collect()] == [1, 2, 3, 3, 4]


def test_sliding_grouped_meets_no_pairs(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 AS k", "timestamp_millis(id) AS ts")  # all in one window
    plan = windows.sliding_grouped(df, 60_000, "id", ["k"], ["count(*) AS n"])
    assert plan.agg(F.sum("n")).first()[0] == 3000 * 3001 // 2
    joins = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "<=" not in joins[0]


def test_sliding_sql(engine):
    engine.ingest("sensors", [("a", 1.0, at(0)), ("b", 2.0, at(1)), ("a", 3.0, at(4.9999)), ("a", 5.0, at(5))])
    text = "SELECT sensor, COUNT(*) AS n, SUM(temp) AS s{} FROM sensors WINDOW SLIDING (SIZE 5 SECONDS) GROUP BY sensor"
    want = [("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 4.0), ("a", 2, 8.0), ("b", 1, 2.0), ("b", 1, 2.0), ("b", 1, 2.0)]
    assert sorted(tuple(r) for r in engine.execute(text.format("")).collect()) == want
    assert sorted(tuple(r)[:3] for r in engine.execute(text.format(", GROUP_CONCAT(temp) AS g")).collect()) == want
