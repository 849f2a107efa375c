"""SQL surface of the special engines: time buckets, points, full-text predicates, retention."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from lumenmill.operators.timeseries import seconds_of

#: name -> (parameters, result type, body); inlined by the optimizer
_FUNCTIONS = {
    "st_point": ("x DOUBLE, y DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE>", "named_struct('x', x, 'y', y)"),
    "st_distance": (
        "a STRUCT<x: DOUBLE, y: DOUBLE>, b STRUCT<x: DOUBLE, y: DOUBLE>", "DOUBLE", "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))",
    ),
    "st_within": (
        "p STRUCT<x: DOUBLE, y: DOUBLE>, px DOUBLE, py DOUBLE, radius DOUBLE", "BOOLEAN",
        "abs(p.x - px) <= radius AND abs(p.y - py) <= radius AND sqrt(pow(p.x - px, 2) + pow(p.y - py, 2)) <= radius",
    ),
    "bucket_start": ("seconds BIGINT, ts TIMESTAMP", "TIMESTAMP", "timestamp_seconds(floor(unix_micros(ts) / (seconds * 1000000)) * seconds)"),
}


def register(spark: SparkSession) -> None:
    """Define the SQL functions of the special engines in a session."""
    for name, (params, kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")


def _contains(cols: str, term: str) -> str:
    text = term.lower().replace("'", "''")
    return f"contains(lower(concat_ws(' ', {cols})), '{text}')"


def _has_token(cols: str, term: str) -> str:
    text = term.lower().replace("'", "''")
    return f"array_contains(split(lower(concat_ws(' ', {cols})), '[^\\\\p{{L}}\\\\p{{N}}]+'), '{text}')"


def match_against(cols: str, query: str, boolean: bool, indexed: str | None = None) -> tuple[str, str]:
    """(condition, score) of MATCH(cols) AGAINST('query').

    For a table with a full-text index on the columns the terms are whole tokens, each worth 1 + ln(N / df).
    """
    if not boolean and indexed:
        tests = [_has_token(cols, t) for t in sorted(set(re.findall(r"[^\W_]+", query.lower())))]
        worth = [f"1 + ln((SELECT count(*) FROM {indexed}) / (SELECT greatest(count_if({t}), 1) FROM {indexed}))" for t in tests]
        return "(" + " OR ".join(tests) + ")", "(" + " + ".join(f"IF({t}, {w}, 0D)" for t, w in zip(tests, worth, strict=True)) + ")"
    if not boolean:
        terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
        tests = [_contains(cols, t) for t in terms]
        return "(" + " OR ".join(tests) + ")", "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + ")"
    phrases = re.findall(r'"([^"]+)"', query)
    words = re.sub(r'"[^"]*"', " ", query).split()
    must = [w[1:] for w in words if w[0] == "+"] + phrases
    never = [w[1:] for w in words if w[0] == "-"]
    may = [w for w in words if w[0] not in "+-"]
    parts = [_contains(cols, t) for t in must] + [f"NOT {_contains(cols, t)}" for t in never]
    if may and not must:
        parts.append("(" + " OR ".join(_contains(cols, t) for t in may) + ")")
    cond = "(" + " AND ".join(parts or ["true"]) + ")"
    return cond, f"CAST({cond} AS INT)"


def _indexed(text: str, cols: str, indexes: dict) -> str | None:
    """The table that the text reads from, if it has a full-text index on the columns."""
    names = {c.strip().lower() for c in cols.split(",")}
    found = re.search(r"\bFROM\s+(\w+)", text, re.I)
    for table, own, kind in indexes.values():
        if kind == "FULLTEXT" and found and table.lower() == found[1].lower() and {c.lower() for c in own} == names:
            return table
    return None


def rewrite(text: str, indexes: dict | None = None) -> str:
    """time_bucket('15m', ts), POINT(x, y) and MATCH ... AGAINST as SQL of Spark."""
    text = re.sub(r"\btime_bucket\s*\(\s*'([^']+)'\s*,", lambda m: f"bucket_start({seconds_of(m[1])}, ", text, flags=re.I)
    text = re.sub(r"\bPOINT\s*\(", "st_point(", text, flags=re.I)
    pattern = re.compile(r"\bMATCH\s*\(([^)]*)\)\s*AGAINST\s*\(\s*'((?:[^']|'')*)'(\s+IN\s+BOOLEAN\s+MODE)?\s*\)(\s+AS\s+\w+)?", re.I)

    def one(m: re.Match) -> str:
        cond, score = match_against(m[1], m[2].replace("''", "'"), bool(m[3]), _indexed(text, m[1], indexes or {}))
        return score + m[4] if m[4] else cond

    return pattern.sub(one, text)
