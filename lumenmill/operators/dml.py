"""Row changes as functions from DataFrames to DataFrames, and constraint checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class EngineError(Exception):
    """An error with a code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.error_code = code


@dataclass
class Constraints:
    """What rows of a table must meet. ``foreign``: columns -> (table, columns)."""

    not_null: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    identity: str | None = None


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; missing columns are null."""
    return target.unionByName(rows.select([F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in target.columns]).to(target.schema), allowMissingColumns=True)


def update(target: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """SET columns where the condition holds; all right sides see the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return target.select([F.when(hit, changes[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which the condition is false or null."""
    return target.limit(0) if where is None else target.where(~F.coalesce(where, F.lit(False)))


def merge(target: DataFrame, source: DataFrame, on: list[str], *, matched: Mapping[str, Column] | None = None, delete_matched: bool = False, insert_new: bool = True) -> DataFrame:
    """MERGE on equal keys: matched rows are updated or deleted, other source rows inserted.

    ``matched`` may use ``s.column`` for the source row. One full outer join; the source must have one row a key.
    """
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    cond = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on])
    j = t.join(s, cond, "full_outer" if insert_new else "left")
    both = F.col("t._t").isNotNull() & F.col("s._s").isNotNull()
    if delete_matched:
        j = j.where(~both)
    out = []
    for c in target.columns:
        kept = F.col(f"t.{c}")
        if matched and c in matched and not delete_matched:
            kept = F.when(both, matched[c]).otherwise(kept)
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        value = F.when(F.col("t._t").isNull(), new).otherwise(kept) if insert_new else kept
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return j.select(out)


@dataclass(frozen=True)
class When:
    """A clause of MERGE: ``kind`` is matched, new (no target row) or gone (no source row). Without values it deletes.

    ``where`` and ``values`` (column to new value) may name the columns of both sides by their aliases.
    """

    kind: str
    where: Column | None = None
    values: Mapping[str, Column] | None = None


def merge_when(target: DataFrame, alias: str, source: DataFrame, on: Column, clauses: list[When]) -> tuple[DataFrame, DataFrame]:
    """MERGE with clauses in order, the first that applies to a row counts: (kept rows, new rows).

    Both sides have aliases (the target that of ``alias``), which the condition and the clauses use. A target row that several source rows match is an
    error if a clause applies to matched rows.
    """
    columns = target.columns
    t, s = target.withColumn("_target_row", F.monotonically_increasing_id()), source.withColumn("_source_row", F.lit(True))
    holds = lambda w: F.lit(True) if w.where is None else F.coalesce(w.where, F.lit(False))
    kinds = {w.kind for w in clauses}
    j = t.join(s, on, "left")
    matched = F.col("_source_row").isNotNull()
    if "matched" in kinds and not j.where(matched).groupBy("_target_row").count().where("count > 1").isEmpty():
        raise EngineError("MERGE_CARDINALITY", "several source rows match a target row")
    at = F.lit(len(clauses))
    for k in range(len(clauses) - 1, -1, -1):
        side = {"matched": matched, "gone": ~matched, "new": F.lit(False)}[clauses[k].kind]
        at = F.when(side & holds(clauses[k]), k).otherwise(at)
    j = j.withColumn("_clause", at) if kinds & {"matched", "gone"} else j.dropDuplicates(["_target_row"]).withColumn("_clause", at)
    own = lambda c: F.col(f"{alias}.`{c}`")
    drops = [k for k, w in enumerate(clauses) if w.values is None and w.kind != "new"]
    out = []
    for c in columns:
        value = own(c)
        for k, w in enumerate(clauses):
            if w.values and c in w.values and w.kind != "new":
                value = F.when(F.col("_clause") == k, w.values[c]).otherwise(value)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    kept = (j.where(~F.col("_clause").isin(drops)) if drops else j).select(out)
    fresh = source.join(target, on, "left_anti")
    taken, new = F.lit(False), target.limit(0).select([own(c).alias(c) for c in columns])
    for w in clauses:
        if w.kind == "new":
            rows = fresh.where(~taken & holds(w))
            taken = taken | holds(w)
            new = new.unionByName(rows.select([w.values[c].cast(target.schema[c].dataType).alias(c) for c in columns if c in w.values]), allowMissingColumns=True)
    return kept, new


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], *, do_nothing: bool = False, columns: list[str] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET the given columns (all, by default)."""
    columns = [] if do_nothing else (columns or [c for c in rows.columns if c not in keys])
    return merge(target, rows, keys, matched={c: F.col(f"s.{c}") for c in columns})


def replace_into(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with an equal key give way to the new ones."""
    return target.join(rows.select(*key), key, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def last_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key, the last by order: prepares a source for :func:`merge`."""
    w = W.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_identity(rows: DataFrame, column: str, start: int) -> DataFrame:
    """Consecutive numbers from ``start`` on for rows whose identity is null; given values are kept.

    Rows are numbered inside their partitions; only the partitions' sizes meet in one place.
    """
    new = rows.where(F.col(column).isNull()).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = new.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    kind = rows.schema[column].dataType
    numbered = new.join(F.broadcast(offsets), part == F.col("_part"))  # a row a partition
    numbered = numbered.withColumn(column, (F.col("_off") + place + start).cast(kind)).select(*rows.columns)
    return rows.where(F.col(column).isNotNull()).unionByName(numbered)


def check(table: DataFrame, c: Constraints, resolve, old: DataFrame | None = None) -> None:
    """Raise :class:`EngineError` where rows break a constraint; ``resolve`` gives other tables by name.

    With ``old``, whose rows are known to be right, ``table`` holds only the rows that join them.
    """
    must = [*c.not_null, *c.primary_key]
    tests = [(F.col(x).isNull(), "NOT_NULL_VIOLATION", x) for x in dict.fromkeys(must)]
    tests += [(~F.coalesce(F.expr(e), F.lit(False)), "CHECK_VIOLATION", e) for e in c.checks]
    if tests:
        found = table.agg(*[F.coalesce(F.max(t.cast("int")), F.lit(0)).alias(f"v{i}") for i, (t, _, _) in enumerate(tests)]).first()
        for v, (_, code, what) in zip(found, tests, strict=True):
            if v:
                raise EngineError(code, what)
    for keys in [k for k in (c.primary_key, *c.unique) if k]:
        live = table.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(*keys)
        twice = live.groupBy(*keys).count().where("count > 1").select(*keys)
        if old is not None:
            twice = twice.unionByName(live.join(old.select(*keys), list(keys), "left_semi"))
        if not twice.isEmpty():
            raise EngineError("UNIQUE_VIOLATION", ", ".join(keys))
    for cols, other, names in c.foreign:
        live = table.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in cols])).select(*cols)
        parents = resolve(other).select(*[F.col(n).alias(k) for n, k in zip(names, cols, strict=True)])
        if not live.join(parents, list(cols), "left_anti").isEmpty():
            raise EngineError("FOREIGN_KEY_VIOLATION", f"{', '.join(cols)} -> {other}")
