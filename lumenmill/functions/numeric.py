"""Mathematical, conversion, radix and bit functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_long(x: Column) -> Column:
    """The nearest integer, halves upwards, as bigint."""
    return F.floor(x + 0.5).cast("long")


MATH = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": round_long, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "log": F.ln,
    "log10": F.log10, "log2": F.log2, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "toRadians": F.radians, "toDegrees": F.degrees, "signum": F.signum, "pow": F.pow, "max": F.greatest, "min": F.least,
    "atan2": F.atan2, "random": F.rand, "PI": F.pi, "E": F.e,
}


def to_radix(v: Column, radix: int) -> Column:
    """Signed lower-case digits of an integer."""
    digits = F.lower(F.conv(F.abs(v).cast("string"), 10, radix))
    return F.concat(F.when(v < 0, "-").otherwise(""), digits)


def parse_radix(s: Column, radix: int) -> Column:
    """An integer from signed digits."""
    size = F.conv(F.ltrim(F.replace(s, F.lit("-"), F.lit(""))), radix, 10).cast("long")
    return F.when(s.startswith("-"), -size).otherwise(size)


def _prefixed(mark: str, radix: int):
    return lambda v: F.concat(F.when(v < 0, "-").otherwise(""), F.lit(mark), F.lower(F.conv(F.abs(v).cast("string"), 10, radix)))


def parse_literal(s: Column) -> Column:
    """An integer from 0x, 0b, 0o or decimal text."""
    body = F.substr(s, F.lit(3))
    return (
        F.when(s.startswith("0x"), F.conv(body, 16, 10)).when(s.startswith("0b"), F.conv(body, 2, 10))
        .when(s.startswith("0o"), F.conv(body, 8, 10)).otherwise(s).cast("long")
    )


RADIX = {"hex": _prefixed("0x", 16), "bin": _prefixed("0b", 2), "oct": _prefixed("0o", 8), "toRadix": to_radix, "parseRadix": parse_radix}


@F.pandas_udf(T.IntegerType())
def float_to_int_bits(x: pd.Series) -> pd.Series:
    """The bits of a 32-bit float."""
    return pd.Series(x.to_numpy(np.float32).view(np.int32))


@F.pandas_udf(T.FloatType())
def int_bits_to_float(x: pd.Series) -> pd.Series:
    """The 32-bit float of some bits."""
    return pd.Series(x.to_numpy(np.int32).view(np.float32))


@F.pandas_udf(T.LongType())
def double_to_long_bits(x: pd.Series) -> pd.Series:
    """The bits of a 64-bit float."""
    return pd.Series(x.to_numpy(np.float64).view(np.int64))


@F.pandas_udf(T.DoubleType())
def long_bits_to_double(x: pd.Series) -> pd.Series:
    """The 64-bit float of some bits."""
    return pd.Series(x.to_numpy(np.int64).view(np.float64))


def _cast(kind: str):
    return lambda x: x.cast(kind)


CONVERSION = {
    "int": _cast("int"), "long": _cast("long"), "float": _cast("float"), "double": _cast("double"), "str": _cast("string"), "bool": _cast("boolean"),
    "intBitsToFloat": int_bits_to_float, "floatToIntBits": float_to_int_bits, "longBitsToDouble": long_bits_to_double,
    "doubleToLongBits": double_to_long_bits, "intToFloat": _cast("float"), "longToDouble": _cast("double"), "floatToInt": _cast("int"), "doubleToLong": _cast("long"),
}

BITWISE = {
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b), "~": F.bitwise_not,
    "<<": lambda a, n: F.call_function("shiftleft", a, n), ">>": lambda a, n: F.call_function("shiftright", a, n),
    ">>>": lambda a, n: F.call_function("shiftrightunsigned", a, n),
}
