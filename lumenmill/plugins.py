"""Plugins: named extensions that add functions, statements and dialect rewrites to engines."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lumenmill.functions import registry
from lumenmill.plans import dialects, statements


@dataclass
class Context:
    """What a plugin may add to."""

    def function(self, name: str, make: Callable, dialect: str = "core") -> None:
        """A function from columns to a column."""
        registry.define(name, make, dialect)

    def statement(self, pattern: str, handler: Callable) -> None:
        """A statement: handler(engine, match, text, args) for texts that match."""
        statements._HANDLERS.insert(0, (re.compile(pattern, re.I | re.S), handler))

    def call(self, dialect: str, name: str, rewrite: Callable[[list[str]], str]) -> None:
        """A call of a dialect's SQL, rewritten from its arguments' texts."""
        dialects._CALLS.setdefault(dialect, {})[name.upper()] = rewrite


_loaded: dict[str, int] = {}


def load(*plugins) -> list[str]:
    """Register plugins (with ``name``, ``order`` and ``register(context)``) once each, lowest order first."""
    for p in sorted(plugins, key=lambda p: getattr(p, "order", 0)):
        if p.name not in _loaded:
            p.register(Context())
            _loaded[p.name] = getattr(p, "order", 0)
    return list(_loaded)
