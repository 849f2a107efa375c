"""The engine session: tables that change, SQL text of five dialects, transactions, procedures and variables."""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import dml, timeseries
from .operators.dml import Constraints, EngineError
from .plans import dialects, special, statements
from .sources.shared import cut

#: Changes of a table after which its plan is cut.
CUT_EVERY = 16
#: Session to the engine whose names are its temp views now.
_active: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


@dataclass
class Table:
    """A name's current rows, what they must meet, hooks and the next identity."""

    rows: DataFrame
    rules: Constraints = field(default_factory=Constraints)
    next_id: int = 1
    triggers: list[tuple[str, str, str]] = field(default_factory=list)
    changes: int = 0
    properties: dict[str, str] = field(default_factory=dict)


class Engine:
    """A catalog over a Spark session. Changing a table replaces its plan; every ``CUT_EVERY`` changes it is written out.

    Several engines of one session have names of their own: the temp views are those of the engine that ran last.
    """

    def __init__(self, spark: SparkSession, dialect: str = "core"):
        self.spark, self.dialect = spark, dialect
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.procedures: dict[str, tuple[list[str], list[str]]] = {}
        self.sequences: dict[str, tuple[int, int, int | None]] = {}
        self.variables: dict[str, object] = {}
        self.indexes: dict[str, tuple[str, tuple[str, ...], str]] = {}
        self.row_count = 0
        self.identity = 0
        special.register(spark)
        self._saved: list[tuple[str | None, dict]] = []

    # --- catalog -------------------------------------------------------------------------

    def activate(self) -> None:
        """Make this engine's names the session's temp views."""
        other = _active.get(self.spark)
        if other is self:
            return
        if other is not None:
            for name in (*other.tables, *other.views):
                self.spark.catalog.dropTempView(name)
        _active[self.spark] = self
        for name, t in self.tables.items():
            t.rows.createOrReplaceTempView(name)
        self._refresh()

    def create_table(self, name: str, schema: str, rules: Constraints | None = None, *, if_not_exists: bool = False) -> None:
        """An empty table of a DDL schema."""
        if name.lower() in self.tables:
            if if_not_exists:
                return
            raise EngineError("TABLE_EXISTS", name)
        self.put(name, self.spark.createDataFrame([], schema), rules)

    def put(self, name: str, rows: DataFrame, rules: Constraints | None = None) -> None:
        """Make rows a table."""
        self.activate()
        old = self.tables.get(name.lower())
        self.tables[name.lower()] = Table(rows, rules or Constraints(), old.next_id if old else 1)
        rows.createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        """The current rows of a table or view."""
        if name.lower() in self.tables:
            return self.tables[name.lower()].rows
        if name.lower() in self.views:
            self.activate()
            return self.spark.sql(self.views[name.lower()])
        raise EngineError("TABLE_NOT_FOUND", name)

    def drop_table(self, name: str, *, if_exists: bool = False) -> None:
        """Forget a table."""
        self.activate()
        if self.tables.pop(name.lower(), None) is None and not if_exists:
            raise EngineError("TABLE_NOT_FOUND", name)
        self.spark.catalog.dropTempView(name)

    def create_view(self, name: str, query: str) -> None:
        """A named query that sees the tables' current rows."""
        self.activate()
        self.views[name.lower()] = query
        self._refresh()

    def _refresh(self) -> None:
        for name, query in self.views.items():
            try:
                self.spark.sql(query).createOrReplaceTempView(name)
            except AnalysisException:  # its tables no longer have what it names: an error once it is read
                self.spark.catalog.dropTempView(name)

    # --- changes -------------------------------------------------------------------------

    def change(self, name: str, event: str, make: Callable[[DataFrame], DataFrame], added: DataFrame | None = None) -> int:
        """Swap a table's rows after its constraints hold; returns how many rows the table gained or lost.

        With ``added``, the change only adds these rows, and only they are checked.
        """
        t = self.tables.get(name.lower())
        if t is None:
            raise EngineError("TABLE_NOT_FOUND", name)
        self.activate()
        self._fire(t, "BEFORE", event)
        rows = make(t.rows)
        if added is not None:
            dml.check(added, t.rules, self.table, t.rows)
        elif event != "DELETE":
            dml.check(rows, t.rules, self.table)
        if event == "DELETE":
            for other in self.tables.values():
                for cols, parent, names in other.rules.foreign:
                    if parent.lower() == name.lower():
                        dml.check(other.rows, Constraints(foreign=((cols, parent, names),)), lambda _: rows)
        t.changes += 1
        t.rows = cut(rows, name.lower()) if t.changes % CUT_EVERY == 0 else rows
        t.rows.createOrReplaceTempView(name)
        self._refresh()
        self._fire(t, "AFTER", event)
        return self.row_count

    def _fire(self, t: Table, when: str, event: str) -> None:
        for at, what, body in t.triggers:
            if (at, what) == (when, event):
                self.execute(body)

    def complete(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows in a table's columns and types, with defaults and identities."""
        t = self.tables[name.lower()]
        for c in t.rows.columns:
            if c not in rows.columns:
                default = t.rules.defaults.get(c)
                rows = rows.withColumn(c, (F.expr(default) if default else F.lit(None)).cast(t.rows.schema[c].dataType))
        rows = rows.select([F.col(c).cast(t.rows.schema[c].dataType).alias(c) for c in t.rows.columns])
        if t.rules.identity:
            rows = dml.with_identity(rows, t.rules.identity, t.next_id)
            self.identity = rows.agg(F.max(t.rules.identity)).first()[0] or self.identity
            t.next_id = max(t.next_id, self.identity + 1)
        return rows

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """Append rows after defaults and identities; returns them."""
        rows = self.complete(name, rows)
        self.change(name, "INSERT", lambda old: old.unionByName(rows), rows)
        return rows

    def insert_batch(self, name: str, columns: list[str], values: Iterable[tuple]) -> int:
        """Many literal rows at once, in one plan."""
        t = self.tables[name.lower()].rows
        values = list(values)
        self.insert(name, self.spark.createDataFrame(values, T.StructType([t.schema[c] for c in columns])))
        self.row_count = len(values)
        return self.row_count

    # --- transactions --------------------------------------------------------------------

    def begin(self, name: str | None = None) -> None:
        """Open a transaction or savepoint: remembers plans, copies nothing."""
        self._saved.append((name, {k: (t.rows, t.next_id) for k, t in self.tables.items()}))

    def commit(self) -> None:
        """Keep all changes."""
        self._saved.clear()

    def rollback(self, name: str | None = None) -> None:
        """Back to a savepoint, which stays, or to the transaction's start."""
        while self._saved:
            label, state = self._saved[-1]
            if name is not None and label != name:
                self._saved.pop()
                continue
            if name is None and len(self._saved) > 1:
                self._saved.pop()
                continue
            for gone in set(self.tables) - set(state):
                self.drop_table(gone)
            for k, (rows, next_id) in state.items():
                self.tables.setdefault(k, Table(rows))
                self.tables[k].rows, self.tables[k].next_id = rows, next_id
                rows.createOrReplaceTempView(k)
            self._refresh()
            if name is None:
                self._saved.pop()
            return
        raise EngineError("NO_TRANSACTION", name or "")

    def release(self, name: str) -> None:
        """Forget a savepoint and those after it."""
        for k, (label, _) in enumerate(self._saved):
            if label == name:
                del self._saved[k:]
                return
        raise EngineError("NO_SAVEPOINT", name)

    def apply_retention(self, name: str, ts: str, now: str = "current_timestamp()") -> None:
        """Delete rows older than the table's ``retention`` property allows."""
        t = self.tables[name.lower()]
        if keep := t.properties.get("retention"):
            kept = timeseries.retain(t.rows, keep, F.expr(now), ts).unionByName(t.rows.where(F.col(ts).isNull()))
            self.change(name, "DELETE", lambda _: kept)

    # --- sequences, procedures -----------------------------------------------------------

    def nextval(self, name: str) -> int:
        """Advance a sequence."""
        start, step, last = self.sequences[name.lower()]
        value = start if last is None else last + step
        self.sequences[name.lower()] = (start, step, value)
        return value

    def currval(self, name: str) -> int:
        """A sequence's last value."""
        last = self.sequences[name.lower()][2]
        if last is None:
            raise EngineError("SEQUENCE_NOT_STARTED", name)
        return last

    def call(self, name: str, args: list[object] | None = None) -> DataFrame | None:
        """Run a procedure's statements with its parameters as variables; returns the last result."""
        if name.lower() not in self.procedures:
            raise EngineError("PROCEDURE_NOT_FOUND", name)
        params, body = self.procedures[name.lower()]
        if len(args or []) > len(params):
            raise EngineError("TOO_MANY_ARGUMENTS", name)
        values = dict(zip(params, args or [], strict=False))
        out = None
        for text in body:
            for p, v in values.items():
                text = dialects.substitute(text, p, v)
            out = self.execute(text)
        return out

    # --- text ----------------------------------------------------------------------------

    def execute(self, text: str, args: list | None = None) -> DataFrame | None:
        """Run one statement of the session's dialect. Queries and RETURNING give a DataFrame, changes give None."""
        self.activate()
        return statements.run(self, special.rewrite(dialects.rewrite(text, self.dialect, self), self.indexes), args)

    def script(self, text: str) -> DataFrame | None:
        """Run statements set apart by semicolons; returns the last result."""
        out = None
        for part in dialects.split_statements(text):
            out = self.execute(part)
        return out

    def query(self, text: str, args: list | None = None) -> DataFrame:
        """Run a query."""
        out = self.execute(text, args)
        if out is None:
            raise EngineError("NOT_A_QUERY", re.sub(r"\s+", " ", text)[:80])
        return out
