"""Scalar functions of the Oracle dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def nvl(a: Column, b: Column) -> Column:
    """The second value where the first is null."""
    return F.coalesce(a, b)


def nvl2(a: Column, present: Column, absent: Column) -> Column:
    """One of two values, by whether the first is null."""
    return F.when(a.isNotNull(), present).otherwise(absent)


def decode(x: Column, *rest: Column) -> Column:
    """DECODE(x, search, result, ... [default]); null matches null."""
    out = rest[-1] if len(rest) % 2 else F.lit(None)
    for k in range(len(rest) - len(rest) % 2 - 2, -1, -2):
        out = F.when(x.eqNullSafe(rest[k]), rest[k + 1]).otherwise(out)
    return out


_PATTERNS = (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss"))


def date_pattern(fmt: str) -> str:
    """A date format of this dialect as Spark's."""
    return re.sub("|".join(a for a, _ in _PATTERNS), lambda m: dict(_PATTERNS)[m[0]], fmt)


def to_char(x: Column, fmt: str | None = None) -> Column:
    """Text of a value, or of a date in a format."""
    return x.cast("string") if fmt is None else F.date_format(x, date_pattern(fmt))


def to_date(s: Column, fmt: str | None = None) -> Column:
    """A date from text."""
    return F.to_date(s) if fmt is None else F.to_date(s, date_pattern(fmt))


def to_number(s: Column) -> Column:
    """A double from text; null if it is none."""
    return s.try_cast("double")


def sysdate() -> Column:
    """Today."""
    return F.current_date()


def months_between(a: Column, b: Column) -> Column:
    """Whole months from b to a."""
    return F.timestamp_diff("MONTH", b, a).cast("double")


def add_months(d: Column, n: Column | int) -> Column:
    """A date some months later; the day is clamped to the month."""
    return F.add_months(d, n)


def trunc_date(d: Column) -> Column:
    """The date part."""
    return F.to_date(d)


def trunc_number(x: Column) -> Column:
    """The floor, as bigint."""
    return F.floor(x).cast("long")


def regexp_like(s: Column, pattern: str) -> Column:
    """Whether the pattern is found; false for null."""
    return F.coalesce(s.rlike(pattern), F.lit(False))


def regexp_substr(s: Column, pattern: str) -> Column:
    """The first match."""
    return F.regexp_substr(s, F.lit(pattern))


FUNCTIONS = {
    "nvl": nvl, "nvl2": nvl2, "decode": decode, "to_char": to_char, "to_date": to_date, "to_number": to_number, "sysdate": sysdate,
    "months_between": months_between, "add_months": add_months, "trunc": trunc_number, "regexp_like": regexp_like, "regexp_substr": regexp_substr,
}
