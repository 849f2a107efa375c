"""Columnar scans and run-length encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column subset; Parquet reads only these."""
    return df.select(*columns)


def column_aggregate(df: DataFrame, function: str, column: str) -> DataFrame:
    """One aggregate over a whole column; 0 where there is no value, as SUM and the numeric extremes of the store have."""
    value = F.expr(f"{function}({column})")
    return df.agg(value.alias("count") if function.lower() == "count" else F.coalesce(value.cast("double"), F.lit(0.0)).alias(function.lower()))


def run_length_encode(df: DataFrame, partition: list[str], order: list[str], column: str) -> DataFrame:
    """Runs of equal values in order, per partition: run number, value, length (gaps and islands)."""
    w = W.partitionBy(*partition).orderBy(*order)
    fresh = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(column).eqNullSafe(F.lag(column).over(w))).cast("int"))
    runs = df.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*partition, "run").agg(F.first(column).alias("value"), F.count(F.lit(1)).alias("length"))


def run_length_decode(runs: DataFrame, partition: list[str]) -> DataFrame:
    """The rows behind runs."""
    return runs.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "length"))).select(*partition, "run", "value")
