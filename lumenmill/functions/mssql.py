"""Scalar functions of the T-SQL dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {"varchar": "string", "nvarchar": "string", "char": "string", "text": "string", "int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "real": "double", "decimal": "double", "numeric": "double"}


def isnull(a: Column, b: Column) -> Column:
    """The second value where the first is null."""
    return F.coalesce(a, b)


def convert(kind: str, x: Column) -> Column:
    """CONVERT(type, x); null where it fails."""
    return x.try_cast(_TYPES.get(re.sub(r"\(.*", "", kind).strip().lower(), kind))


def getdate() -> Column:
    """Today."""
    return F.current_date()


def datediff(unit: str, start: Column, end: Column) -> Column:
    """Whole units between the dates."""
    return F.timestamp_diff(unit.upper(), F.to_date(start), F.to_date(end))


def dateadd(unit: str, n: Column, d: Column) -> Column:
    """A date some units later."""
    return F.to_date(F.timestamp_add(unit.upper(), n, F.to_date(d)))


def stuff(s: Column, start: Column, size: Column, new: Column) -> Column:
    """Replace part of a text, 1-based."""
    return F.overlay(s, new, start, size)


def charindex(sub: Column, s: Column, start: int = 1) -> Column:
    """Position of a text, from 1; 0 if absent or null."""
    return F.coalesce(F.call_function("locate", sub, s, F.lit(start)), F.lit(0)).cast("long")


def patindex(pattern: str, s: Column) -> Column:
    """Position where a %pattern% begins, without regard to case; 0 if absent."""
    body = re.escape(pattern).replace("%", ".*").replace("_", ".")
    return F.coalesce(F.regexp_instr(s, F.lit("(?i)" + body)), F.lit(0)).cast("long")


def format_(x: Column, fmt: str) -> Column:
    """N0, N2, '#,##0' and '#,##0.00'."""
    places = int(fmt[1:] or 2) if fmt[:1].upper() == "N" else len(fmt.partition(".")[2])
    return F.format_number(x, places)


def newid() -> Column:
    """A random UUID."""
    return F.expr("uuid()")


FUNCTIONS = {
    "isnull": isnull, "convert": convert, "getdate": getdate, "datediff": datediff, "dateadd": dateadd, "stuff": stuff,
    "charindex": charindex, "patindex": patindex, "format": format_, "newid": newid,
}
