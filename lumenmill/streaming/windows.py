"""Event-time windows and stream joins; the same plan runs on batch and streaming DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MILLIS = {"ms": 1, "millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(n: int, unit: str) -> int:
    """Milliseconds of n units: ms, seconds, minutes, hours, days."""
    u = unit.lower()
    u = u if u == "ms" else u.removesuffix("s")
    if u not in _MILLIS:
        raise ValueError(f"unknown unit {unit}")
    return n * _MILLIS[u]


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _text(ms: int) -> str:
    return f"{ms} milliseconds"


def tumbling(size_ms: int, ts: str = "ts") -> Column:
    """[k * size, (k + 1) * size)."""
    return F.window(ts, _text(size_ms))


def hopping(size_ms: int, advance_ms: int, ts: str = "ts") -> Column:
    """Windows of a size that start every advance; a row falls into size / advance of them."""
    return F.window(ts, _text(size_ms), _text(advance_ms))


def session(gap_ms: int, ts: str = "ts", *, touch: bool = False) -> Column:
    """Rows less than the gap apart; at exactly the gap a new session starts, unless ``touch``."""
    return F.session_window(ts, f"{gap_ms * 1000 - (0 if touch else 1)} microseconds")


def windowed(df: DataFrame, window: Column, keys: list[str], aggregates: list[Column], *, lateness: str | None = None, ts: str = "ts") -> DataFrame:
    """Aggregates per window and key, with the window's bounds. ``lateness`` sets the watermark of a stream."""
    if lateness:
        df = df.withWatermark(ts, lateness)
    out = df.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding(df: DataFrame, size_ms: int, keys: list[str], aggregates: dict[str, Column], ts: str = "ts") -> DataFrame:
    """One window for each event: (ts - size, ts] to the microsecond, peers included. Batch only."""
    w = W.partitionBy(*keys).orderBy(_micros(ts)).rangeBetween(-(size_ms * 1000 - 1), 0)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})


def sliding_grouped(df: DataFrame, size_ms: int, anchor: str, keys: list[str], aggregates: list[Column | str], ts: str = "ts") -> DataFrame:
    """For each event as an anchor, the events of its window (ts - size, ts] grouped by keys, to the microsecond.

    Time is cut into cells of the window's size, so a window is the end of one cell and the start of the next. Aggregates
    given as text, COUNT, SUM, AVG, MIN or MAX of an expression without brackets, are put together from running ones over
    both: work grows with the events and the result. Any others meet the events of a window pair by pair, by an equi-join
    of an anchor with its own cell and the one before.
    """
    size = size_ms * 1000
    timed = df.withColumn("_at", _micros(ts)).where("_at IS NOT NULL").withColumn("_cell", F.col("_at") - F.pmod("_at", F.lit(size)))
    made = [F.expr(a) if isinstance(a, str) else a for a in aggregates]
    known = [_SIMPLE.fullmatch(a) if isinstance(a, str) else None for a in aggregates]
    kinds = df.select(*[F.expr(k[2]).alias(f"_v{n}") for n, k in enumerate(known) if k and k[2].strip() != "*"]).dtypes if all(known) else []
    # averages of decimals and intervals have rules of their own
    if all(known) and all(known[int(c[2:])][1].lower() != "avg" or kind in _PLAIN for c, kind in kinds):
        out = df.agg(*made).schema
        return _sliding_parts(timed, size, anchor, keys, [(k[1].lower(), k[2].strip(), f.name, f.dataType) for k, f in zip(known, out, strict=True)])
    a = timed.select(F.col(anchor).alias("_anchor"), F.col("_at").alias("_to"), F.explode(F.array("_cell", F.col("_cell") - size)).alias("_cell"))
    pairs = a.join(timed, "_cell").where((F.col("_at") <= F.col("_to")) & (F.col("_at") > F.col("_to") - size))
    return pairs.groupBy(F.col("_anchor").alias("anchor"), *keys).agg(*made)


#: Types whose averages are doubles, and an aggregate in text: function and argument.
_PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double")
_SIMPLE = re.compile(r"(?is)\s*(count|sum|avg|min|max)\s*\(\s*(\*|(?!(?:distinct|all)\b)[^(),]+?)\s*\)(?:\s*as\s+\w+)?\s*")


def _sliding_parts(timed: DataFrame, size: int, anchor: str, keys: list[str], wanted: list[tuple]) -> DataFrame:
    """Windows by running aggregates: over an anchor's own cell up to it, and over the cell before, backwards down to its start.

    Per cell and key there are three kinds of rows: the cell's events, those of the cell before, and the anchors of the
    cell, each once for each key that either cell has.
    """
    # values that are aggregated: whether there is an event, then the arguments; an average is made of a sum and a count
    values, steps = {"n": F.lit(1)}, {"n": F.count}
    for k, (what, arg, _, _) in enumerate(wanted):
        values[f"{k}"] = F.lit(1) if arg == "*" else F.expr(arg)
        steps[f"{k}"] = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.sum}[what]
        if what == "avg":
            values[f"{k}"] = values[f"{k}"].cast("double")
            values[f"{k}c"], steps[f"{k}c"] = values[f"{k}"], F.count
    key = [F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)]
    names, at = [f"_k{k}" for k in range(len(keys))], F.col("_at")
    events = timed.select(*key, "_cell", "_at", *[v.alias(f"_v{c}") for c, v in values.items()])
    part = lambda p, cell, low: [*names, cell.alias("_cell"), "_at", low.alias("_low"), *[F.col(f"_v{c}").alias(f"{p}{c}") for c in values]]
    rows = events.select(part("_own", F.col("_cell"), at)).unionByName(events.select(part("_was", F.col("_cell") + size, at)), allowMissingColumns=True)
    seen = events.select(*names, F.explode(F.array("_cell", F.col("_cell") + size)).alias("_cell")).distinct()
    probes = timed.select(F.col(anchor).alias("anchor"), "_cell", "_at").join(seen.hint("merge"), "_cell")
    probes = probes.select("anchor", *names, "_cell", "_at", (at - size + 1).alias("_low"), F.lit(True).alias("_probe"))
    rows = rows.unionByName(probes, allowMissingColumns=True)
    to = W.partitionBy(*names, "_cell").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    back = W.partitionBy(*names, "_cell").orderBy(F.desc("_low")).rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"_own{c}": steps[c](f"_own{c}").over(to) for c in values}).withColumns({f"_was{c}": steps[c](f"_was{c}").over(back) for c in values})
    rows = rows.where("_probe AND _ownn + _wasn > 0")

    def both(c: str) -> Column:
        """The two parts as one, and those of rows that share an anchor's name."""
        p, q, f = F.col(f"_own{c}"), F.col(f"_was{c}"), steps[c]
        if f in (F.min, F.max):
            return f((F.least if f is F.min else F.greatest)(p, q))
        return F.sum(F.coalesce(p + q, p, q))

    ends = [(F.try_divide(both(f"{k}"), both(f"{k}c")) if what == "avg" else F.coalesce(both(f"{k}"), F.lit(0)) if what == "count" else both(f"{k}")).cast(kind).alias(name) for k, (what, _, name, kind) in enumerate(wanted)]
    done = rows.groupBy("anchor", *names).agg(*ends)
    return done.select("anchor", *[F.col(n).alias(c) for n, c in zip(names, keys, strict=True)], *[F.col(f"`{w[2]}`") for w in wanted])


def is_late(ts: Column, watermark: Column, lateness_ms: int) -> Column:
    """Whether an event comes after the watermark less the lateness has passed it."""
    return F.unix_millis(ts.cast("timestamp")) < F.unix_millis(watermark.cast("timestamp")) - lateness_ms


def late_filter(df: DataFrame, lateness_ms: int, order: list[str], ts: str = "ts", partition: list[str] | None = None) -> DataFrame:
    """Rows that are not late, where the watermark is the latest event time of the rows before them in arrival order."""
    w = W.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = F.max(F.col(ts)).over(w)
    return df.withColumn("_mark", seen).where(F.col("_mark").isNull() | ~is_late(F.col(ts), F.col("_mark"), lateness_ms)).drop("_mark")


def stream_join(left: DataFrame, right: DataFrame, key: str, within_ms: int, ts: str = "ts", lateness: str | None = None) -> DataFrame:
    """Pairs of equal key whose times differ by at most the window; right columns are prefixed, the time is the later.

    On streams the watermarks let the state be dropped; in batch the key makes it an equi-join.
    """
    r = right.select([F.col(c).alias(f"right_{c}") for c in right.columns])
    if lateness:
        left, r = left.withWatermark(ts, lateness), r.withWatermark(f"right_{ts}", lateness)
    span = F.expr(f"INTERVAL {within_ms / 1000} SECONDS")
    near = F.col(f"right_{ts}").between(F.col(ts) - span, F.col(ts) + span)
    out = left.join(r, (F.col(key) == F.col(f"right_{key}")) & near)
    return out.withColumn("joined_ts", F.greatest(ts, f"right_{ts}"))


def lookup_join(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a table, whose columns replace those of the same name. Spark chooses how, by the table's size."""
    kept = [c for c in stream.columns if c == key or c not in table.columns]
    return stream.select(*kept).join(table, key)
