"""Scalar functions of the MySQL dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PERCENT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss", "%M": "MMMM", "%b": "MMM"}


def date_pattern(fmt: str) -> str:
    """A percent format as Spark's."""
    return re.sub(r"%[A-Za-z]", lambda m: _PERCENT.get(m[0], m[0][1:]), fmt)


def if_(cond: Column, yes: Column, no: Column) -> Column:
    """One of two values."""
    return F.when(F.coalesce(cond, F.lit(False)), yes).otherwise(no)


def ifnull(a: Column, b: Column) -> Column:
    """The second value where the first is null."""
    return F.coalesce(a, b)


def group_concat(x: Column, sep: str = ",") -> Column:
    """Aggregate: values joined in their own order."""
    return F.array_join(F.array_sort(F.collect_list(x.cast("string"))), sep)


def locate(sub: Column, s: Column, start: int = 1) -> Column:
    """Position of a text, from 1; 0 if absent or null."""
    return F.coalesce(F.call_function("locate", sub, s, F.lit(start)), F.lit(0)).cast("long")


def instr(s: Column, sub: Column) -> Column:
    """As :func:`locate` with arguments swapped."""
    return F.coalesce(F.call_function("instr", s, sub), F.lit(0)).cast("long")


def lpad(s: Column, n: int, pad: str) -> Column:
    """Pad on the left, or cut, to n characters."""
    return F.lpad(s, n, pad)


def rpad(s: Column, n: int, pad: str) -> Column:
    """Pad on the right, or cut, to n characters."""
    return F.rpad(s, n, pad)


def field(x: Column, *items: Column) -> Column:
    """1-based place of x among the items, 0 if absent."""
    return F.coalesce(F.array_position(F.array(*items), x), F.lit(0)).cast("long")


def find_in_set(x: Column, items: Column) -> Column:
    """1-based place of x in a comma list whose items are trimmed, 0 if absent."""
    return F.coalesce(F.array_position(F.transform(F.split(items, ","), lambda i: F.trim(i)), x), F.lit(0)).cast("long")


def date_format(d: Column, fmt: str) -> Column:
    """Text of a date in a percent format."""
    return F.date_format(d, date_pattern(fmt))


def str_to_date(s: Column, fmt: str) -> Column:
    """A date from text in a percent format."""
    return F.to_date(s, date_pattern(fmt))


def unix_timestamp(ts: Column | None = None) -> Column:
    """Seconds since the epoch."""
    return F.unix_timestamp(ts) if ts is not None else F.unix_timestamp()


def from_unixtime(s: Column) -> Column:
    """ISO local date-time in UTC."""
    return F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss")


FUNCTIONS = {
    "if": if_, "ifnull": ifnull, "group_concat": group_concat, "locate": locate, "instr": instr, "lpad": lpad, "rpad": rpad, "field": field,
    "find_in_set": find_in_set, "date_format": date_format, "str_to_date": str_to_date, "unix_timestamp": unix_timestamp, "from_unixtime": from_unixtime,
}
