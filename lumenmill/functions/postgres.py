"""Scalar functions of the PostgreSQL dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .oracle import date_pattern


def string_agg(x: Column, sep: str) -> Column:
    """Aggregate: values joined in their own order."""
    return F.array_join(F.array_sort(F.collect_list(x.cast("string"))), sep)


def array_agg(x: Column) -> Column:
    """Aggregate: values as an array in their own order."""
    return F.array_sort(F.collect_list(x))


def age(d: Column, now: Column | None = None) -> Column:
    """'y years m mons d days' from a date to now."""
    now = F.current_date() if now is None else now
    months = F.timestamp_diff("MONTH", d, now)
    days = F.date_diff(now, F.add_months(F.to_date(d), months.cast("int")))
    return F.concat_ws(" ", F.floor(months / 12).cast("string"), F.lit("years"), (months % 12).cast("string"), F.lit("mons"), days.cast("string"), F.lit("days"))


def date_trunc(field: str, ts: Column) -> Column:
    """Start of the year, month, day or hour."""
    return F.date_trunc(field, ts)


def extract(field: str, ts: Column) -> Column:
    """A date field; dow is 1 (Monday) to 7, week counts from January 1st."""
    field = field.lower()
    if field == "dow":
        return (F.weekday(ts) + 1).cast("long")
    if field == "week":
        return (F.floor((F.dayofyear(ts) - 1) / 7) + 1).cast("long")
    return F.date_part(F.lit("doy" if field == "doy" else field), ts).cast("long")


def to_char(x: Column, fmt: str, *, number: bool = False) -> Column:
    """A number with the format's decimals, or a date in a format."""
    if number:
        return F.format_string(f"%.{len(fmt.partition('.')[2])}f", x.cast("double"))
    return F.date_format(x, date_pattern(fmt))


def to_timestamp(epoch: Column) -> Column:
    """A timestamp from seconds."""
    return F.timestamp_seconds(epoch)


def generate_series(a: Column, b: Column, step: Column | None = None) -> Column:
    """An array of integers from a to b."""
    return F.sequence(a, b, step) if step is not None else F.sequence(a, b)


def array_length(a: Column) -> Column:
    """Items of an array."""
    return F.size(a).cast("long")


def array_append(a: Column, x: Column) -> Column:
    """An array with one more item."""
    return F.array_append(a, x)


def array_cat(a: Column, b: Column) -> Column:
    """Two arrays as one."""
    return F.concat(a, b)


def regexp_matches(s: Column, pattern: str) -> Column:
    """All whole matches."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def regexp_replace(s: Column, pattern: str, new: str, flags: str = "") -> Column:
    """The first match, or all with the flag g."""
    if "g" in flags:
        return F.regexp_replace(s, pattern, new)
    parts = F.split(s, pattern, 2)
    return F.when(s.rlike(pattern), F.concat(F.get(parts, F.lit(0)), F.lit(new), F.get(parts, F.lit(1)))).otherwise(s)


def initcap(s: Column) -> Column:
    """Upper case after anything that is no letter or digit, lower case elsewhere."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def format_(pattern: str, *args: Column) -> Column:
    """%s formatting."""
    return F.format_string(pattern, *args)


def pg_typeof(kind: str) -> str:
    """The dialect's name of a Spark type."""
    if kind.startswith("array"):
        return "array"
    return {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "double precision", "float": "double precision", "boolean": "boolean"}.get(kind, "text")


def left(s: Column, n: int) -> Column:
    """The first n characters; a negative n leaves off the last ones."""
    return F.left(s, F.lit(n)) if n >= 0 else F.left(s, F.greatest(F.char_length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """The last n characters; a negative n leaves off the first ones."""
    return F.right(s, F.lit(n)) if n >= 0 else F.right(s, F.greatest(F.char_length(s) + n, F.lit(0)))


FUNCTIONS = {
    "coalesce": F.coalesce, "nullif": F.nullif, "string_agg": string_agg, "array_agg": array_agg, "now": F.current_timestamp,
    "age": age, "date_trunc": date_trunc, "extract": extract, "to_char": to_char, "to_timestamp": to_timestamp,
    "generate_series": generate_series, "array_length": array_length, "array_append": array_append, "array_cat": array_cat,
    "regexp_matches": regexp_matches, "regexp_replace": regexp_replace, "md5": F.md5, "initcap": initcap, "concat_ws": F.concat_ws,
    "format": format_, "pg_typeof": pg_typeof, "left": left, "right": right, "length": F.length,
}
