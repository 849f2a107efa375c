"""Documents: filters, updates, pipelines, collections and CQL."""

import pytest

from lumenmill.documents.collection import DocumentStore, Pipeline, Query, Update
from lumenmill.documents.cql import CqlSession
from lumenmill.operators.dml import EngineError


@pytest.fixture
def people(spark):
    c = DocumentStore(spark).collection("people")
    c.insert_many([
        {"_id": "a", "name": "Alice", "age": 30, "city": "Helsinki", "tags": ["java", "sql"], "home": {"zip": "1"}},
        {"_id": "b", "name": "Bob", "age": 25, "city": "Tampere", "tags": ["sql", "nosql"], "home": {"zip": "2"}},
        {"_id": "c", "name": "Charlie", "age": 35, "city": "Helsinki", "tags": ["nosql"]},
    ])
    return c


def ids(df):
    return sorted(r["_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"city": "Helsinki"}, "ac"), ({"age": {"$gt": 25, "$lte": 35}}, "ac"), ({"age": {"$in": [25, 30]}}, "ab"), ({"age": {"$nin": [25]}}, "ac"),
        ({"home": {"$exists": False}}, "c"), ({"name": {"$regex": "^A"}}, "a"), ({"$or": [{"age": 25}, {"age": 35}]}, "bc"), ({"$nor": [{"age": 25}]}, "ac"),
        ({"$not": {"city": "Helsinki"}}, "b"), ({"home.zip": "2"}, "b"), (Query.and_(Query.eq("city", "Helsinki"), Query.gt("age", 30)), "c"), ({"home.zip": {"$ne": "1"}}, "bc"),
    ],
)
def test_filters(people, query, want):
    assert ids(people.find(query)) == list(want)


def test_updates(people):
    assert people.update_many({"city": "Helsinki"}, Update().inc("age", 1).push("tags", "x").set("home.zip", "9")) == 2
    assert people.find_one({"_id": "a"})["tags"] == ["java", "sql", "x"]
    assert people.find_one({"_id": "a"})["home"]["zip"] == "9"
    people.update_one({"_id": "b"}, {"$pull": {"tags": {"$eq": "sql"}}, "$addToSet": {"tags": "nosql"}, "$rename": {"city": "town"}})
    b = people.find_one({"_id": "b"})
    assert (b["tags"], b["town"], b["city"]) == (["nosql"], "Tampere", None)
    people.replace_one({"_id": "c"}, {"name": "Cy"})
    assert people.find_one({"_id": "c"})["age"] is None
    assert people.delete_one({"age": {"$exists": True}}) == 1
    assert people.count() == 2


def test_pipeline(people, spark):
    out = people.aggregate(Pipeline().unwind("$tags").group("$tags", n={"$sum": 1}, who={"$push": "$name"}, oldest={"$max": "$age"}).sort({"n": -1, "_id": 1}))
    assert [(r["_id"], r["n"], sorted(r["who"]), r["oldest"]) for r in out.collect()] == [("nosql", 2, ["Bob", "Charlie"], 35), ("sql", 2, ["Alice", "Bob"], 30), ("java", 1, ["Alice"], 30)]
    people.store.collection("cities").insert_many([{"_id": "1", "town": "Helsinki", "size": 6}])
    got = people.aggregate(Pipeline().lookup("cities", "city", "town", "info").add_fields({"up": {"$toUpper": "$name"}, "dbl": {"$multiply": ["$age", 2]}}).project({"up": 1, "dbl": 1, "info": 1}))
    assert sorted((r["up"], r["dbl"], len(r["info"])) for r in got.collect()) == [("ALICE", 60.0, 1), ("BOB", 50.0, 0), ("CHARLIE", 70.0, 1)]
    assert people.aggregate([{"$match": {"age": {"$gte": 30}}}, {"$count": "n"}]).first()["n"] == 2
    assert ids(people.find({}, sort={"age": -1}, skip=1, limit=1)) == ["a"]


def test_errors_and_indexes(people):
    with pytest.raises(EngineError):
        people.find({"age": {"$foo": 1}})
    people.create_index("by_name", ["name"], unique=True)
    with pytest.raises(EngineError):
        people.insert_one({"name": "Bob"})
    assert people.store.execute_command("people", {"count": {}}) == 3
    assert sorted(r[0] for r in people.distinct("city").collect()) == ["Helsinki", "Tampere"]


def test_cql(spark):
    s = CqlSession(spark)
    s.execute("CREATE KEYSPACE app WITH replication = {'class': 'SimpleStrategy'}")
    s.execute("USE app")
    s.execute("CREATE TABLE IF NOT EXISTS ev (id text, ts bigint, data text, n int, PRIMARY KEY ((id), ts))")
    put = s.prepare("INSERT INTO ev (id, ts, data, n) VALUES (?, ?, ?, ?)")
    for row in [("a", 1, "x", 1), ("a", 2, "y", 2), ("b", 1, "z", 3)]:
        put(*row)
    put("a", 1, "new", 9)  # an upsert on the primary key
    assert sorted(tuple(r) for r in s.execute("SELECT id, ts, data FROM ev WHERE n >= 2 ALLOW FILTERING").collect()) == [("a", 1, "new"), ("a", 2, "y"), ("b", 1, "z")]
    assert s.execute("SELECT COUNT(*) FROM ev WHERE id = 'a'").first()[0] == 2
    assert sorted(r[0] for r in s.execute("SELECT DISTINCT id FROM ev").collect()) == ["a", "b"]
    s.execute("BEGIN BATCH INSERT INTO ev (id, ts, n) VALUES ('c', 1, 1); UPDATE ev SET data = 'q' WHERE id = 'b'; DELETE FROM ev WHERE id = 'a' AND ts = 2; APPLY BATCH")
    assert sorted(tuple(r) for r in s.execute("SELECT id, data FROM ev").collect()) == [("a", "new"), ("b", "q"), ("c", None)]
    s.execute("DELETE data FROM ev WHERE id = 'b'")
    s.execute("INSERT INTO ev (id, ts) VALUES ('t', 1) USING TTL 0")
    assert s.execute("SELECT id FROM ev WHERE id IN ('t', 'b') LIMIT 5").collect() == [("b",)]
    s.execute("TRUNCATE ev")
    assert s.execute("SELECT count(*) FROM ev").first()[0] == 0
    s.execute("DROP TABLE ev")
    with pytest.raises(EngineError):
        s.execute("SELECT * FROM ev")


def test_time_to_live(people):
    people.insert_one({"_id": "gone", "name": "Old"}, ttl_seconds=0)
    people.insert_one({"_id": "new", "name": "New"}, ttl_seconds=600)
    assert ids(people.find()) == ["a", "b", "c", "new"]
    assert people.update_many({"_id": "new"}, {"$set": {"age": 1}}) == 1
    assert ids(people.find()) == ["a", "b", "c", "new"]
    people.create_index("x", ["name"])
    people.drop_index("x")
    assert people.indexes == {}
