"""Collections of documents over DataFrames, builders and command documents."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.operators.dml import EngineError

from . import compiler


class Collection:
    """A named set of documents with inferred schema; changing it replaces its plan."""

    def __init__(self, store: DocumentStore, name: str, rows: DataFrame | None = None):
        self.store, self.name, self.rows = store, name, rows
        self.indexes: dict[str, dict] = {}

    # documents in
    def insert_one(self, doc: dict, ttl_seconds: int | None = None) -> str:
        """Insert a document; returns its id."""
        return self.insert_many([doc], ttl_seconds)[0]

    def insert_many(self, docs: list[dict], ttl_seconds: int | None = None) -> list[str]:
        """Insert documents in one plan, with a time to live if given; returns their ids."""
        docs = [{"_id": str(uuid.uuid4())} | d for d in docs]
        spark = self.store.spark
        new = spark.read.json(spark.sparkContext.parallelize([json.dumps(d, default=str) for d in docs]))
        if ttl_seconds is not None:
            until = dt.datetime.now(dt.UTC) + dt.timedelta(seconds=ttl_seconds)
            new = new.withColumn("_expires", F.lit(until))
        rows = new if self.rows is None else self.rows.unionByName(new, allowMissingColumns=True)
        self._check(rows)
        self.rows = rows
        return [d["_id"] for d in docs]

    def _check(self, rows: DataFrame) -> None:
        unique = [["_id"], *[list(s["keys"]) for s in self.indexes.values() if s.get("unique")]]
        for keys in unique:
            live = self._live(rows).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
            if not live.groupBy(*keys).count().where("count > 1").isEmpty():
                raise EngineError("DUPLICATE_KEY", ", ".join(keys))

    # documents out
    def _all(self) -> DataFrame:
        return self._live(self._raw()).drop("_expires")

    def _raw(self) -> DataFrame:
        return self.rows if self.rows is not None else self.store.spark.createDataFrame([], "_id string")

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        if "_expires" not in rows.columns:
            return rows
        return rows.where(F.col("_expires").isNull() | (F.col("_expires") > F.current_timestamp()))

    def find(self, query: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        """Documents that match, as a lazy DataFrame."""
        stages: list[dict] = [{"$match": query or {}}]
        stages += [{"$sort": sort}] if sort else []
        stages += [{"$skip": skip}] if skip else []
        stages += [{"$limit": limit}] if limit is not None else []
        stages += [{"$project": projection}] if projection else []
        return self.aggregate(stages)

    def find_one(self, query: dict | None = None) -> dict | None:
        """One document that matches."""
        row = self.find(query).first()
        return row.asDict(recursive=True) if row else None

    def count(self, query: dict | None = None) -> int:
        """How many match."""
        return self._all().where(compiler.where(query or {})).count()

    def distinct(self, path: str, query: dict | None = None) -> DataFrame:
        """The distinct non-null values of a field."""
        c = compiler.field(path)
        return self._all().where(compiler.where(query or {})).where(c.isNotNull()).select(c.alias(path)).distinct()

    def aggregate(self, stages: list[dict]) -> DataFrame:
        """Run a pipeline."""
        return compiler.pipeline(self._all(), stages, lambda n: self.store.collection(n)._all())

    # changes
    def _hit(self, query: dict, one: bool):
        cond = compiler.where(query)
        if not one:
            return cond
        first = self._all().where(cond).agg(F.min("_id")).first()[0]
        return F.col("_id").eqNullSafe(F.lit(first)) & cond

    def update_many(self, query: dict, change: dict, one: bool = False) -> int:
        """Apply an update document to all that match, or to the one of least id; returns how many."""
        hit = self._hit(query, one)
        n = self._all().where(hit).count()
        if n:
            rows = compiler.apply_update(self._raw(), hit, change)
            self._check(rows)
            self.rows = rows
        return n

    def update_one(self, query: dict, change: dict) -> int:
        """Update one document."""
        return self.update_many(query, change, one=True)

    def replace_one(self, query: dict, doc: dict) -> int:
        """Replace one document; its id stays, fields it lacks become null."""
        gone = {c: None for c in self._all().columns if c != "_id" and c not in doc}
        return self.update_many(query, {"$set": {k: v for k, v in doc.items() if k != "_id"}, "$unset": gone} if gone else {"$set": doc}, one=True)

    def delete_many(self, query: dict, one: bool = False) -> int:
        """Delete all that match, or the one of least id; returns how many."""
        hit = self._hit(query, one)
        n = self._all().where(hit).count()
        self.rows = self._raw().where(~hit)
        return n

    def delete_one(self, query: dict) -> int:
        """Delete one document."""
        return self.delete_many(query, one=True)

    def create_index(self, name: str, keys: list[str], *, unique: bool = False) -> None:
        """Index metadata; a unique one is checked on every change."""
        self.indexes[name] = {"keys": keys, "unique": unique}
        self._check(self._all())

    def drop_index(self, name: str) -> None:
        """Forget an index."""
        self.indexes.pop(name, None)

    def drop(self) -> None:
        """Forget the collection."""
        self.store.collections.pop(self.name, None)


class DocumentStore:
    """Named collections and command documents."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, Collection] = {}

    def collection(self, name: str) -> Collection:
        """A collection, made when first named."""
        return self.collections.setdefault(name, Collection(self, name))

    def execute_command(self, name: str, command: dict) -> object:
        """{operation: argument} on a collection."""
        c = self.collection(name)
        ((op, a),) = command.items()
        table = {
            "insertOne": lambda: c.insert_one(a), "insertMany": lambda: c.insert_many(a), "find": lambda: c.find(a), "findOne": lambda: c.find_one(a),
            "count": lambda: c.count(a), "updateOne": lambda: c.update_one(a["filter"], a["update"]), "updateMany": lambda: c.update_many(a["filter"], a["update"]),
            "deleteOne": lambda: c.delete_one(a), "deleteMany": lambda: c.delete_many(a), "aggregate": lambda: c.aggregate(a),
            "distinct": lambda: c.distinct(a), "drop": lambda: c.drop(), "createCollection": lambda: c, "dropCollection": lambda: c.drop(),
        }
        if op not in table:
            raise EngineError("NOSQL_QUERY_ERROR", f"unknown command {op}")
        return table[op]()


# --- builders ------------------------------------------------------------------------------


class Query:
    """Filter documents: Query.eq('a', 1), Query.and_(...)."""

    eq = staticmethod(lambda f, v: {f: {"$eq": v}})
    ne = staticmethod(lambda f, v: {f: {"$ne": v}})
    gt = staticmethod(lambda f, v: {f: {"$gt": v}})
    gte = staticmethod(lambda f, v: {f: {"$gte": v}})
    lt = staticmethod(lambda f, v: {f: {"$lt": v}})
    lte = staticmethod(lambda f, v: {f: {"$lte": v}})
    in_ = staticmethod(lambda f, v: {f: {"$in": v}})
    nin = staticmethod(lambda f, v: {f: {"$nin": v}})
    exists = staticmethod(lambda f, v=True: {f: {"$exists": v}})
    regex = staticmethod(lambda f, v: {f: {"$regex": v}})
    and_ = staticmethod(lambda *q: {"$and": list(q)})
    or_ = staticmethod(lambda *q: {"$or": list(q)})
    nor = staticmethod(lambda *q: {"$nor": list(q)})
    not_ = staticmethod(lambda q: {"$not": q})


class Update(dict):
    """Update documents: Update().set('a', 1).inc('n', 2)."""

    def _add(self, op: str, path: str, v: object) -> Update:
        self.setdefault(op, {})[path] = v
        return self

    def set(self, path: str, v: object) -> Update:
        """Set a field."""
        return self._add("$set", path, v)

    def unset(self, path: str) -> Update:
        """Clear a field."""
        return self._add("$unset", path, "")

    def inc(self, path: str, n: float) -> Update:
        """Add to a field."""
        return self._add("$inc", path, n)

    def push(self, path: str, v: object) -> Update:
        """Append to an array."""
        return self._add("$push", path, v)

    def pull(self, path: str, v: object) -> Update:
        """Remove from an array."""
        return self._add("$pull", path, v)

    def add_to_set(self, path: str, v: object) -> Update:
        """Append to an array unless present."""
        return self._add("$addToSet", path, v)

    def rename(self, old: str, new: str) -> Update:
        """Rename a field."""
        return self._add("$rename", old, new)


class Pipeline(list):
    """Stage lists: Pipeline().match(...).group(...)."""

    def _add(self, op: str, arg: object) -> Pipeline:
        self.append({op: arg})
        return self

    match = lambda self, q: self._add("$match", q)
    project = lambda self, s: self._add("$project", s)
    sort = lambda self, s: self._add("$sort", s)
    limit = lambda self, n: self._add("$limit", n)
    skip = lambda self, n: self._add("$skip", n)
    unwind = lambda self, p: self._add("$unwind", p)
    add_fields = lambda self, s: self._add("$addFields", s)
    count = lambda self, n: self._add("$count", n)

    def group(self, key: object, **accumulators: dict) -> Pipeline:
        """Group by a key."""
        return self._add("$group", {"_id": key, **accumulators})

    def lookup(self, other: str, local: str, foreign: str, name: str) -> Pipeline:
        """Join another collection."""
        return self._add("$lookup", {"from": other, "localField": local, "foreignField": foreign, "as": name})
