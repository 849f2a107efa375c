"""Lookup of scalar functions by dialect, and user-defined functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from . import core, mssql, mysql, numeric, oracle, postgres

DIALECTS: dict[str, dict[str, Callable]] = {
    "core": core.FUNCTIONS, "oracle": oracle.FUNCTIONS, "mssql": mssql.FUNCTIONS, "mysql": mysql.FUNCTIONS, "postgresql": postgres.FUNCTIONS,
    "math": numeric.MATH, "radix": numeric.RADIX, "conversion": numeric.CONVERSION, "bitwise": numeric.BITWISE,
}


def lookup(name: str, dialect: str = "core") -> Callable[..., Column]:
    """A function of a dialect, or of the core."""
    for kind in (dialect, "core"):
        if found := DIALECTS[kind].get(name) or DIALECTS[kind].get(name.lower()):
            return found
    raise KeyError(f"{dialect} has no function {name}")


def define(name: str, function: Callable, dialect: str = "core") -> None:
    """Add a function from columns to a column."""
    DIALECTS.setdefault(dialect, {})[name.lower()] = function


def define_sql(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """A SQL function, inlined by the optimizer: name(params) RETURNS returns = body."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
