"""Filter, update and pipeline documents compiled to columns and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmill.operators.dml import EngineError


def field(path: str) -> Column:
    """A dotted path."""
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _value(v: object) -> Column:
    return F.array(*map(_value, v)) if isinstance(v, list) else F.lit(v)


# --- filters -------------------------------------------------------------------------------


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def condition(c: Column, test: object) -> Column:
    """A field's test: a value, or a document of operators."""
    if not (isinstance(test, dict) and test and all(k.startswith("$") for k in test)):
        return c.eqNullSafe(_value(test))
    return reduce(lambda a, b: a & b, [_operator(c, op, v) for op, v in test.items()])


def _operator(c: Column, op: str, v: object) -> Column:
    simple = {
        "$eq": lambda: c.eqNullSafe(_value(v)), "$ne": lambda: ~c.eqNullSafe(_value(v)), "$gt": lambda: _false_if_null(c > _value(v)),
        "$gte": lambda: _false_if_null(c >= _value(v)), "$lt": lambda: _false_if_null(c < _value(v)), "$lte": lambda: _false_if_null(c <= _value(v)),
        "$in": lambda: _member(c, v), "$nin": lambda: ~_member(c, v), "$exists": lambda: c.isNotNull() if v else c.isNull(),
        "$regex": lambda: _false_if_null(c.rlike(v)), "$not": lambda: ~condition(c, v),
    }
    if op not in simple:
        raise EngineError("NOSQL_QUERY_ERROR", f"unknown operator {op}")
    return simple[op]()


def _member(c: Column, items: list) -> Column:
    found = _false_if_null(c.isin([i for i in items if i is not None]))
    return found | c.isNull() if None in items else found


def where(query: dict) -> Column:
    """A filter document."""
    parts = [F.lit(True)]
    for k, v in query.items():
        if k == "$and":
            parts.append(reduce(lambda a, b: a & b, map(where, v)))
        elif k == "$or":
            parts.append(reduce(lambda a, b: a | b, map(where, v)))
        elif k == "$nor":
            parts.append(~reduce(lambda a, b: a | b, map(where, v)))
        elif k == "$not":
            parts.append(~where(v))
        elif k.startswith("$"):
            raise EngineError("NOSQL_QUERY_ERROR", f"unknown operator {k}")
        else:
            parts.append(condition(field(k), v))
    return reduce(lambda a, b: a & b, parts)


# --- expressions ---------------------------------------------------------------------------


def expression(e: object) -> Column:
    """A computed value: '$path', a literal, or an operator document."""
    if isinstance(e, str) and e.startswith("$"):
        return field(e[1:])
    if not isinstance(e, dict):
        return F.lit(e)
    ((op, args),) = e.items()
    parts = [expression(a) for a in (args if isinstance(args, list) else [args])]
    if op == "$concat":
        return F.concat_ws("", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    if op == "$add":
        return reduce(lambda a, b: a + b, [F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts])
    if op == "$multiply":
        return reduce(lambda a, b: a * b, [p.cast("double") for p in parts])
    if op == "$subtract":
        return parts[0].cast("double") - parts[1].cast("double")
    one = {"$toLower": F.lower, "$toUpper": F.upper, "$toString": lambda c: c.cast("string")}
    if op in one:
        return one[op](parts[0])
    raise EngineError("NOSQL_QUERY_ERROR", f"unknown expression {op}")


# --- updates -------------------------------------------------------------------------------


def _with(df: DataFrame, hit: Column, path: str, make) -> DataFrame:
    """Set a possibly nested field where the filter holds; a missing top-level field is added."""
    top, _, rest = path.partition(".")
    old = field(path) if _has(df.schema, path) else F.lit(None)
    new = F.when(hit, make(old)).otherwise(old)
    return df.withColumn(top, F.col(f"`{top}`").withField(rest, new) if rest else new)


def _has(schema: T.StructType, path: str) -> bool:
    top, _, rest = path.partition(".")
    if top not in schema.fieldNames():
        return False
    return not rest or (isinstance(schema[top].dataType, T.StructType) and _has(schema[top].dataType, rest))


def apply_update(df: DataFrame, hit: Column, change: dict) -> DataFrame:
    """The rows after an update document; without operators it sets its fields."""
    df = df.withColumn("_hit", hit)
    hit = F.col("_hit")
    if not any(k.startswith("$") for k in change):
        change = {"$set": {k: v for k, v in change.items() if k != "_id"}}
    for op, fields in change.items():
        for path, v in fields.items():
            makers = {
                "$set": lambda old, v=v: _value(v), "$unset": lambda old: F.lit(None),
                "$inc": lambda old, v=v: F.coalesce(old, F.lit(0)) + F.lit(v),
                "$push": lambda old, v=v: F.array_append(F.coalesce(old, F.array()), _value(v)),
                "$pull": lambda old, v=v: F.filter(old, lambda x: ~condition(x, v)),
                "$addToSet": lambda old, v=v: F.when(F.array_contains(old, _value(v)), old).otherwise(F.array_append(F.coalesce(old, F.array()), _value(v))),
                "$min": lambda old, v=v: F.least(old, F.lit(v)), "$max": lambda old, v=v: F.greatest(old, F.lit(v)),
                "$mul": lambda old, v=v: F.coalesce(old, F.lit(0)) * F.lit(v),
            }
            if op == "$rename":
                df = df.withColumn(v, F.when(hit, field(path)).otherwise(F.col(v) if v in df.columns else F.lit(None)))
                df = df.withColumn(path, F.when(~hit, field(path)))
            elif op in makers:
                df = _with(df, hit, path, makers[op])
            else:
                raise EngineError("NOSQL_UPDATE_ERROR", f"unknown operator {op}")
    return df.drop("_hit")


# --- pipelines -----------------------------------------------------------------------------


def _project(df: DataFrame, spec: dict) -> DataFrame:
    if not any(v == 1 or isinstance(v, (dict, str)) for k, v in spec.items() if k != "_id") and spec != {"_id": 1}:
        return df.drop(*[k for k, v in spec.items() if v == 0])
    out = [F.col("_id")] if spec.get("_id", 1) and "_id" in df.columns else []
    for k, v in spec.items():
        if k != "_id" and v:
            out.append(field(k).alias(k) if v == 1 else expression(v).alias(k))
    return df.select(*out)


def _order(spec: dict) -> list[Column]:
    return [field(k).asc_nulls_first() if d >= 0 else field(k).desc_nulls_last() for k, d in spec.items()]


def _accumulator(op: str, arg: object, at: Column) -> Column:
    c = expression(arg)
    if op == "$sum":
        return F.count(F.lit(1)) * F.lit(arg) if isinstance(arg, (int, float)) else F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    table = {
        "$avg": lambda: F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), "$min": lambda: F.min(c), "$max": lambda: F.max(c), "$count": lambda: F.count(F.lit(1)),
        # a struct keeps nulls, which collect_list would drop
        "$push": lambda: F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), c.alias("v")))), lambda s: s["v"]),
        "$addToSet": lambda: F.array_sort(F.collect_set(c)), "$first": lambda: F.min_by(c, at), "$last": lambda: F.max_by(c, at),
    }
    if op not in table:
        raise EngineError("NOSQL_QUERY_ERROR", f"unknown accumulator {op}")
    return table[op]()


def _group(df: DataFrame, spec: dict, order: Column | None) -> DataFrame:
    key = expression(spec["_id"]).alias("_id")
    if order is None:  # encounter order: by id where there is one
        df = df.withColumn("_order", F.col("_id") if "_id" in df.columns else F.monotonically_increasing_id())
        order = F.col("_order")
    made = []
    for name, acc in spec.items():
        if name != "_id":
            ((op, arg),) = acc.items()
            made.append(_accumulator(op, arg, order).alias(name))
    return df.groupBy(key).agg(*made) if made else df.select(key).distinct()


def _lookup(df: DataFrame, spec: dict, collections) -> DataFrame:
    """A left outer join whose matches become an array; null matches null."""
    other = collections(spec["from"])
    matches = other.groupBy(field(spec["foreignField"]).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*other.columns))).alias("_m"))
    out = df.join(matches, field(spec["localField"]).eqNullSafe(F.col("_k")), "left")
    none = F.array().cast(matches.schema["_m"].dataType)
    return out.withColumn(spec["as"], F.coalesce("_m", none)).drop("_k", "_m")


def pipeline(df: DataFrame, stages: list[dict], collections=None, order: Column | None = None) -> DataFrame:
    """Run stages one after the other. ``order`` says what first and last mean; ``collections`` finds others by name."""
    for stage in stages:
        if len(stage) != 1:
            raise EngineError("NOSQL_QUERY_ERROR", "a stage has one key")
        ((op, arg),) = stage.items()
        if op == "$match":
            df = df.where(where(arg))
        elif op == "$project":
            df = _project(df, arg)
        elif op == "$sort":
            df = df.orderBy(*_order(arg))
        elif op == "$limit":
            df = df.limit(arg)
        elif op == "$skip":
            df = df.offset(arg)
        elif op == "$group":
            df = _group(df, arg, order)
        elif op == "$unwind":
            path = (arg if isinstance(arg, str) else arg["path"]).removeprefix("$")
            kind = df.schema[path].dataType
            df = df.withColumn(path, F.explode(field(path))) if isinstance(kind, T.ArrayType) else df.where(field(path).isNotNull())
        elif op == "$lookup":
            df = _lookup(df, arg, collections)
        elif op == "$addFields":
            df = df.withColumns({k: expression(v) for k, v in arg.items()})
        elif op == "$count":
            df = df.agg(F.count(F.lit(1)).alias(arg))
        else:
            raise EngineError("NOSQL_QUERY_ERROR", f"unknown stage {op}")
    return df
