"""Row-limiting and key-wise operators that SQL dialects add to the relational core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. One shuffle on the keys."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top(df: DataFrame, n: int, order: list[Column], *, percent: bool = False, ties: bool = False) -> DataFrame:
    """TOP n [PERCENT] [WITH TIES]. A plain count becomes a per-partition top-k; percent is rounded up."""
    if percent:
        n = -(-df.count() * n // 100)
    first = df.orderBy(*order).limit(n)
    if not ties:
        return first
    # the rows that tie with the last one kept: its keys are one row, so the join side is bounded
    names = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[c_key(o).alias(k) for o, k in zip(order, names, strict=True)])
    last = keyed.orderBy(*order).limit(n).select(F.struct(*names).alias("_s"), *order_rank(order))
    bound = last.orderBy(F.col("_rank").desc()).limit(1).select(F.col("_s").alias("_last"))
    tied = keyed.join(F.broadcast(bound), F.struct(*names).eqNullSafe(F.col("_last")))
    inside = keyed.orderBy(*order).limit(n).join(F.broadcast(bound), ~F.struct(*names).eqNullSafe(F.col("_last")))
    return inside.unionByName(tied).select(*df.columns)


def c_key(order: Column) -> Column:
    """The plain expression below a sort direction."""
    text = str(order).removeprefix("Column<'").removesuffix("'>")
    for suffix in (" ASC NULLS FIRST", " ASC NULLS LAST", " DESC NULLS FIRST", " DESC NULLS LAST"):
        text = text.removesuffix(suffix)
    return F.expr(text)


def order_rank(order: list[Column]) -> list[Column]:
    """Position in the given order, for a bounded number of rows."""
    return [F.row_number().over(W.orderBy(*order)).alias("_rank")]


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    """ALTER TABLE ADD COLUMN with a default."""
    return df.withColumn(name, F.lit(default).cast(kind))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """ALTER TABLE RENAME COLUMN; data and position are kept."""
    return df.withColumnRenamed(old, new)


def generate_series(spark, start: int, stop: int, step: int = 1) -> DataFrame:
    """Integers from start to stop, both included, as a distributed range."""
    if not step:
        raise ValueError("step must not be 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "generate_series")
