"""Time buckets, gap filling and retention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SECONDS = {"s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400}


def seconds_of(interval: str) -> int:
    """Seconds of '15m', '1h', '30s', '7d'."""
    m = re.fullmatch(r"\s*(\d+)\s*(s|min|m|h|d)\s*", interval.lower())
    if not m:
        raise ValueError(f"not an interval: {interval!r}")
    return int(m[1]) * _SECONDS[m[2]]


def bucket(interval: str, ts: str = "ts") -> Column:
    """Start of the interval that a timestamp is in, aligned to the epoch."""
    n = seconds_of(interval)
    return F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (n * 1_000_000)) * n)


def time_bucket(df: DataFrame, interval: str, value: str, ts: str = "ts", keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Per bucket: n, sum, avg, min, max, first and last value; null timestamps are left out."""
    at = F.struct(ts, order) if order else F.struct(ts)
    return (
        df.where(F.col(ts).isNotNull()).groupBy(bucket(interval, ts).alias("bucket"), *(keys or []))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.min(value).alias("min"),
            F.max(value).alias("max"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"),
        )
    )


def gap_fill(buckets: DataFrame, interval: str, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each bucket between a key's first and last; missing values carry the last known one forward."""
    step = F.expr(f"INTERVAL {seconds_of(interval)} SECONDS")
    span = buckets.groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias("bucket"))
    w = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    # a key may be null, and its rows belong together like those of any other
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "bucket")]
    own = [F.col(f"g.{c}").alias(c) for c in (*keys, "bucket")]
    rest = [F.col(f"b.{c}").alias(c) for c in buckets.columns if c not in (*keys, "bucket")]
    filled = grid.alias("g").join(buckets.alias("b"), same, "left").select(*own, *rest)
    return filled.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def retain(df: DataFrame, interval: str, now: Column, ts: str = "ts") -> DataFrame:
    """Rows not older than the retention interval."""
    return df.where(F.col(ts).cast("timestamp") >= now - F.expr(f"INTERVAL {seconds_of(interval)} SECONDS"))
