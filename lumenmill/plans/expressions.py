"""A small expression and scripting tree: pure parts compile to columns, control flow runs on the driver."""

from __future__ import annotations

import operator
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenmill.functions import registry
from lumenmill.operators.dml import EngineError


@dataclass
class Limits:
    """Bounds on a script's run."""

    recursion: int = 256
    loops: int = 100_000
    seconds: float = 30.0


def lit(v):
    """A literal."""
    return ("lit", v)


def var(name):
    """A variable, or a column when compiled."""
    return ("var", name)


def op(sign, *args):
    """An operator: arithmetic, comparison, logic, bits."""
    return ("op", sign, *args)


def call(name, *args):
    """A function call."""
    return ("call", name, *args)


def if_(cond, yes, no=("lit", None)):
    """A conditional."""
    return ("if", cond, yes, no)


def index(array, at):
    """An item of an array."""
    return ("index", array, at)


_COLUMN_OPS: dict[str, Callable] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod, "==": operator.eq, "!=": operator.ne,
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "&&": operator.and_, "||": operator.or_, "!": operator.invert,
    **registry.DIALECTS["bitwise"],
}


def compile_column(node: tuple) -> Column:
    """A pure expression as a column; strings concatenate with +."""
    kind, *rest = node
    if kind == "lit":
        return F.array(*map(F.lit, rest[0])) if isinstance(rest[0], list) else F.lit(rest[0])
    if kind == "var":
        return F.col(rest[0])
    if kind == "if":
        return F.when(compile_column(rest[0]), compile_column(rest[1])).otherwise(compile_column(rest[2]))
    if kind == "index":
        return F.get(compile_column(rest[0]), compile_column(rest[1]))
    if kind == "call":
        for family in ("math", "conversion", "radix"):
            if found := registry.DIALECTS[family].get(rest[0]):
                return found(*[a[1] if family == "radix" and k and a[0] == "lit" else compile_column(a) for k, a in enumerate(rest[1:])])
        return registry.lookup(rest[0])(*map(compile_column, rest[1:]))
    if kind == "op":
        sign, args = rest[0], rest[1:]
        if sign == "+" and any(a[0] == "lit" and isinstance(a[1], str) for a in args):
            return F.concat(*[compile_column(a).cast("string") for a in args])
        if sign == "-" and len(args) == 1:
            return -compile_column(args[0])
        return _COLUMN_OPS[sign](*map(compile_column, args))
    raise EngineError("NOT_AN_EXPRESSION", kind)


class _Return(Exception):
    def __init__(self, value):
        self.value = value


_SCALAR_OPS = {
    **{k: v for k, v in _COLUMN_OPS.items() if k not in ("&&", "||", "!", "/", "%", "+")},
    "&": operator.and_, "|": operator.or_, "^": operator.xor, "~": operator.invert, "<<": operator.lshift, ">>": operator.rshift,
    ">>>": lambda a, n: (a & (1 << 64) - 1) >> n,
}


@dataclass
class Script:
    """Runs statement trees with nested scopes: assign, block, while, do_while, for, def, call, return, if."""

    limits: Limits = field(default_factory=Limits)
    scopes: list[dict] = field(default_factory=lambda: [{}])
    functions: dict[str, tuple[list[str], tuple]] = field(default_factory=dict)
    statistics: dict[str, int] = field(default_factory=lambda: {"nodes": 0, "loops": 0, "calls": 0})

    def run(self, node: tuple):
        """The value of a tree."""
        self._until = time.monotonic() + self.limits.seconds
        try:
            return self._eval(node)
        except _Return as r:
            return r.value

    def _eval(self, node: tuple):
        self.statistics["nodes"] += 1
        if time.monotonic() > self._until:
            raise EngineError("TIMEOUT", "the script ran too long")
        return getattr(self, f"_{node[0]}")(*node[1:])

    def _lit(self, v):
        return v

    def _var(self, name):
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        raise EngineError("UNKNOWN_VARIABLE", name)

    def _assign(self, name, value):
        v = self._eval(value)
        for s in reversed(self.scopes):
            if name in s:
                s[name] = v
                return v
        self.scopes[-1][name] = v
        return v

    def _block(self, *nodes):
        self.scopes.append({})
        try:
            out = None
            for n in nodes:
                out = self._eval(n)
            return out
        finally:
            self.scopes.pop()

    def _if(self, cond, yes, no):
        return self._eval(yes if self._eval(cond) else no)

    def _loop(self):
        self.statistics["loops"] += 1
        if self.statistics["loops"] > self.limits.loops:
            raise EngineError("LOOP_LIMIT", str(self.limits.loops))

    def _while(self, cond, body):
        out = None
        while self._eval(cond):
            self._loop()
            out = self._eval(body)
        return out

    def _do_while(self, body, cond):
        while True:
            self._loop()
            out = self._eval(body)
            if not self._eval(cond):
                return out

    def _for(self, start, cond, step, body):
        self.scopes.append({})
        try:
            self._eval(start)
            return self._while(cond, ("block", body, step))
        finally:
            self.scopes.pop()

    def _def(self, name, params, body):
        self.functions[name] = (list(params), body)

    def _return(self, value):
        raise _Return(self._eval(value))

    def _index(self, array, at):
        items, k = self._eval(array), self._eval(at)
        return items[k] if isinstance(items, dict) or 0 <= k < len(items) else None

    def _call(self, name, *args):
        if name not in self.functions:
            raise EngineError("UNKNOWN_FUNCTION", name)
        params, body = self.functions[name]
        values = [self._eval(a) for a in args] + [None] * (len(params) - len(args))
        self.statistics["calls"] += 1
        if len(self.scopes) > self.limits.recursion:
            raise EngineError("RECURSION_LIMIT", str(self.limits.recursion))
        self.scopes.append(dict(zip(params, values, strict=False)))
        try:
            return self._eval(body)
        except _Return as r:
            return r.value
        finally:
            self.scopes.pop()

    def _op(self, sign, *args):
        if sign == "&&":
            return bool(self._eval(args[0])) and bool(self._eval(args[1]))
        if sign == "||":
            return bool(self._eval(args[0])) or bool(self._eval(args[1]))
        values = [self._eval(a) for a in args]
        if sign == "!":
            return not values[0]
        if sign == "-" and len(values) == 1:
            return -values[0]
        if sign == "+" and any(isinstance(v, str) for v in values):
            return "".join("null" if v is None else str(v) for v in values)
        if sign == "+":
            return values[0] + values[1]
        if sign in "/%":
            if values[1] == 0 and all(isinstance(v, int) for v in values):
                raise EngineError("DIVISION_BY_ZERO", sign)
            if all(isinstance(v, int) for v in values):  # truncates towards zero
                q = abs(values[0]) // abs(values[1]) * (1 if (values[0] < 0) == (values[1] < 0) else -1)
                return q if sign == "/" else values[0] - q * values[1]
            return values[0] / values[1] if sign == "/" else values[0] % values[1]
        return _SCALAR_OPS[sign](*values)
