"""Core scalar functions, and the compatibility forms that differ from ANSI Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SPACE = r"[\s]"


def trim(s: Column) -> Column:
    """Strip all white space, tabs and line ends included."""
    return F.regexp_replace(s, rf"^{_SPACE}+|{_SPACE}+$", "")


def ltrim(s: Column) -> Column:
    """Strip leading white space."""
    return F.regexp_replace(s, rf"^{_SPACE}+", "")


def rtrim(s: Column) -> Column:
    """Strip trailing white space."""
    return F.regexp_replace(s, rf"{_SPACE}+$", "")


def length(s: Column) -> Column:
    """Characters, as bigint."""
    return F.char_length(s).cast("long")


def concat(*parts: Column) -> Column:
    """CONCAT that skips nulls."""
    return F.concat_ws("", *parts)


def substring(s: Column, start: Column | int, size: Column | int | None = None) -> Column:
    """1-based; a start below 1 is 1."""
    at = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    n = F.char_length(s) if size is None else (F.lit(size) if isinstance(size, int) else size)
    return F.substring(s, at, n)


# --- compatibility: semantics that are not ANSI's ---------------------------------------------


def eq(a: Column, b: Column) -> Column:
    """= that holds for two nulls."""
    return F.when(a.isNull() & b.isNull(), True).otherwise(a == b)


def ne(a: Column, b: Column) -> Column:
    """<> that is false for two nulls."""
    return F.when(a.isNull() & b.isNull(), False).otherwise(a != b)


def and_(*conds: Column) -> Column:
    """AND whose null operands are false."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conds])


def or_(*conds: Column) -> Column:
    """OR whose null operands are false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conds])


def not_(cond: Column) -> Column:
    """NOT of a condition whose null is false."""
    return ~F.coalesce(cond, F.lit(False))


def truthy(c: Column, kind: str) -> Column:
    """Non-zero number, non-empty string, true boolean, any other non-null value."""
    if kind in ("string", "varchar"):
        return F.coalesce(F.char_length(c) > 0, F.lit(False))
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("int", "bigint", "long", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def in_list(x: Column, items: list) -> Column:
    """IN over the non-null items; null only for a null probe."""
    kept = [i for i in items if i is not None]
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(x.isin(kept) if kept else F.lit(False))


def not_in_list(x: Column, items: list) -> Column:
    """The negation of :func:`in_list`."""
    return ~in_list(x, items)


def like(s: Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return s.ilike(pattern)


def int_divide(a: Column, b: Column) -> Column:
    """Truncating integer division; null by zero."""
    return F.when(b != 0, (a - F.try_mod(a, b)) / b).cast("long")


def divide(a: Column, b: Column) -> Column:
    """Division; null by zero."""
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    """Remainder; null by zero."""
    return F.try_mod(a, b)


def wrap_add(a: Column, b: Column) -> Column:
    """64-bit addition that wraps around, by adding the halves."""
    a, b = a.cast("long"), b.cast("long")
    low = F.bitwise_not(F.lit(0).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    lo = a.bitwiseAND(low) + b.bitwiseAND(low)
    hi = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(lo, 32)
    return F.shiftleft(hi, 32).bitwiseOR(lo.bitwiseAND(low))


def sum_or_zero(c: Column) -> Column:
    """SUM that is 0 without input."""
    return F.coalesce(F.sum(c), F.lit(0))


def round_half_up(x: Column, scale: int = 0) -> Column:
    """Rounding of halves towards plus infinity, as a double."""
    f = float(10**scale)
    return F.floor(x * F.lit(f) + F.lit(0.5)) / F.lit(f)


def ntile(n: int, partition: list[Column], order: list[Column]) -> Column:
    """Buckets floor(i * n / size) + 1."""
    w = W.partitionBy(*partition)
    return (F.floor((F.row_number().over(w.orderBy(*order)) - 1) * n / F.count(F.lit(1)).over(w)) + 1).cast("long")


def rows_frame(partition: list[Column], order: list[Column]) -> W:
    """The default frame by rows instead of by range."""
    return W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def count_rows(over: W) -> Column:
    """COUNT over a frame, nulls included."""
    return F.count(F.lit(1)).over(over)


FUNCTIONS = {
    "upper": F.upper, "lower": F.lower, "trim": trim, "ltrim": ltrim, "rtrim": rtrim, "length": length, "concat": concat,
    "replace": F.replace, "substring": substring, "coalesce": F.coalesce, "nullif": F.nullif, "abs": F.abs, "round": F.round,
    "ceil": F.ceil, "floor": F.floor, "now": F.current_timestamp, "current_date": F.current_date,
}
