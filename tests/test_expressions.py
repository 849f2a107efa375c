"""Expression trees, scripts and scalar functions."""

import pytest
from pyspark.sql import functions as F

from lumenmill.functions import core, mssql, mysql, numeric, oracle, postgres, registry
from lumenmill.operators.dml import EngineError
from lumenmill.plans.expressions import Limits, Script, call, compile_column, if_, index, lit, op, var


def one(spark, c, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c.alias("x")).first()[0]


def test_compile(spark):
    tree = if_(op(">", var("a"), lit(2)), op("*", var("a"), call("pow", lit(2.0), lit(3.0))), lit(-1.0))
    assert one(spark, compile_column(tree), a=5) == 40.0
    assert one(spark, compile_column(op("+", lit("n="), var("a"))), a=5) == "n=5"
    assert one(spark, compile_column(index(lit([7, 8]), lit(1)))) == 8
    assert one(spark, compile_column(op("&", lit(6), lit(3)))) == 2


def test_script():
    fact = ("def", "f", ["n"], ("if", op("<", var("n"), lit(2)), lit(1), op("*", var("n"), call("f", op("-", var("n"), lit(1))))))
    assert Script().run(("block", fact, call("f", lit(10)))) == 3628800
    loop = ("block", ("assign", "s", lit(0)), ("for", ("assign", "i", lit(0)), op("<", var("i"), lit(5)), ("assign", "i", op("+", var("i"), lit(1))), ("assign", "s", op("+", var("s"), var("i")))), ("return", var("s")))
    assert Script().run(loop) == 10
    with pytest.raises(EngineError):
        Script(Limits(loops=10)).run(("while", lit(True), lit(1)))
    with pytest.raises(EngineError):
        Script(Limits(recursion=20)).run(("block", ("def", "g", [], call("g")), call("g")))
    assert Script().run(op("/", lit(-7), lit(2))) == -3


CASES = [
    (lambda: core.trim(F.lit("\t a ")), "a"), (lambda: core.concat(F.lit("a"), F.lit(None), F.lit("b")), "ab"), (lambda: core.substring(F.lit("abc"), -3, 2), "ab"),
    (lambda: core.round_half_up(F.lit(-2.5)), -2.0), (lambda: core.int_divide(F.lit(-7), F.lit(2)), -3), (lambda: core.int_divide(F.lit(7), F.lit(0)), None),
    (lambda: core.wrap_add(F.lit(2**63 - 1), F.lit(1)), -(2**63)), (lambda: core.eq(F.lit(None), F.lit(None)), True), (lambda: core.not_(core.and_(F.lit(None).cast("boolean"), F.lit(True))), True),
    (lambda: core.not_in_list(F.lit(3), [1, None]), True), (lambda: core.like(F.lit("ABC"), "a%"), True), (lambda: core.truthy(F.lit(""), "string"), False),
    (lambda: oracle.decode(F.lit(None), F.lit(None), F.lit("n"), F.lit("d")), "n"), (lambda: oracle.decode(F.lit(3), F.lit(1), F.lit("a")), None), (lambda: oracle.nvl2(F.lit(1), F.lit("y"), F.lit("n")), "y"),
    (lambda: oracle.to_char(F.lit("2024-02-03").cast("date"), "DD/MM/YYYY"), "03/02/2024"), (lambda: oracle.regexp_substr(F.lit("ab12"), r"\d+"), "12"), (lambda: oracle.to_number(F.lit("x")), None),
    (lambda: mssql.stuff(F.lit("abcdef"), F.lit(2), F.lit(3), F.lit("X")), "aXef"), (lambda: mssql.charindex(F.lit("c"), F.lit("abc")), 3), (lambda: mssql.patindex("%c%", F.lit("abC")), 1),
    (lambda: mssql.convert("INT", F.lit("z")), None), (lambda: mssql.format_(F.lit(1234.567), "#,##0.00"), "1,234.57"), (lambda: mssql.datediff("MONTH", F.lit("2024-01-31"), F.lit("2024-03-31")), 2),
    (lambda: mysql.field(F.lit("c"), F.lit("a"), F.lit("c")), 2), (lambda: mysql.find_in_set(F.lit("b"), F.lit("a, b")), 2), (lambda: mysql.lpad(F.lit("abc"), 2, "x"), "ab"), (lambda: mysql.from_unixtime(F.lit(0)), "1970-01-01T00:00:00"),
    (lambda: postgres.initcap(F.lit("foo-bar bAZ")), "Foo-Bar Baz"), (lambda: postgres.left(F.lit("abcd"), -1), "abc"), (lambda: postgres.right(F.lit("abcd"), -1), "bcd"), (lambda: postgres.regexp_replace(F.lit("aXbX"), "X", "-"), "a-bX"),
    (lambda: postgres.extract("dow", F.lit("2024-01-07").cast("date")), 7), (lambda: postgres.extract("week", F.lit("2024-01-08").cast("date")), 2), (lambda: postgres.to_char(F.lit(3.14159), "9.99", number=True), "3.14"),
    (lambda: numeric.to_radix(F.lit(-10), 2), "-1010"), (lambda: numeric.parse_radix(F.lit("-ff"), 16), -255), (lambda: numeric.RADIX["hex"](F.lit(255)), "0xff"), (lambda: numeric.parse_literal(F.lit("0b101")), 5),
    (lambda: numeric.double_to_long_bits(F.lit(1.5)), 4609434218613702656), (lambda: numeric.long_bits_to_double(F.lit(4609434218613702656)), 1.5), (lambda: numeric.round_long(F.lit(2.5)), 3), (lambda: numeric.BITWISE[">>>"](F.lit(-1).cast("int"), F.lit(28)), 15),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_function(spark, k):
    made, want = CASES[k]
    assert one(spark, made()) == want


def test_registry(spark):
    registry.define("twice", lambda c: c * 2)
    assert one(spark, registry.lookup("twice", "oracle")(F.lit(4))) == 8
    registry.define_sql(spark, "plus_one", "x INT", "INT", "x + 1")
    assert spark.sql("SELECT plus_one(4)").first()[0] == 5
    with pytest.raises(KeyError):
        registry.lookup("nope")
