"""Streams by name: ingest, continuous queries and ad-hoc windowed queries in SQL text."""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmill.operators.dml import EngineError
from lumenmill.plans.dialects import _Stream, join
from lumenmill.sources.shared import shared_dir

from . import windows

_KINDS = {"varchar": "string", "text": "string", "integer": "int", "datetime": "timestamp"}
_ids = itertools.count()


@dataclass
class Stream:
    """A source directory, its schema and its properties."""

    path: str
    schema: T.StructType
    properties: dict[str, str] = field(default_factory=dict)
    ts: str = "ts"


@dataclass
class Select:
    """A parsed query."""

    items: list[str]
    source: str
    window: tuple[str, list[int]] | None
    where: str | None
    group: list[str]
    final: bool


def parse(text: str) -> Select:
    """SELECT items FROM s [WINDOW kind (SIZE n unit, ADVANCE n unit | GAP n unit)] [WHERE] [GROUP BY] [EMIT]."""
    s = _Stream(text)
    frm, win, where, group, emit = s.find("FROM"), s.find("WINDOW"), s.find("WHERE"), s.find("GROUP", "BY"), s.find("EMIT")
    end = lambda k: min([x for x in (win, where, group, emit, len(s.t)) if x > k])
    window = None
    if win > 0:
        inside = s.t[win + 3 : s.close(win + 2)]
        sizes = [windows.millis(int(inside[k + 1][1]), inside[k + 2][1]) for k in range(len(inside)) if inside[k][1].upper() in ("SIZE", "ADVANCE", "GAP")]
        window = (s.word(win + 1), sizes)
    items, depth, at = [], 0, 1
    for k in range(1, frm + 1):
        c = s.t[k][1]
        if (c == "," and not depth) or k == frm:
            items.append(join(s.t[at:k]))
            at = k + 1
        depth += (c == "(") - (c == ")")
    return Select(
        items, s.t[frm + 1][1], window, join(s.t[where + 1 : end(where)]) if where > 0 else None,
        [c.strip() for c in join(s.t[group + 2 : end(group)]).split(",")] if group > 0 else [], emit > 0 and s.word(emit + 1) == "FINAL",
    )


def plan(rows: DataFrame, q: Select, ts: str = "ts", lateness: str | None = None) -> DataFrame:
    """The DataFrame of a parsed query over batch or streaming rows."""
    if lateness and rows.isStreaming:
        rows = rows.withWatermark(ts, lateness)
    if q.where:
        rows = rows.where(F.coalesce(F.expr(q.where), F.lit(False)))
    aggregates = [i for i in q.items if re.match(r"(?i)(count|sum|avg|min|max|group_concat)\s*\(", i)]
    made = [F.expr(re.sub(r"(?i)^group_concat \( (\w+) \)", r"array_join(array_sort(collect_list(cast(\1 AS string))), ',')", i)) for i in aggregates]
    if not aggregates:
        return rows.selectExpr(*q.items)
    if not q.window:
        return rows.groupBy(*q.group).agg(*made)
    kind, sizes = q.window
    if kind == "SLIDING":
        rows = rows.withColumn("_anchor_id", F.monotonically_increasing_id())
        text = [m if i.lower().startswith("group_concat") else i for i, m in zip(aggregates, made, strict=True)]
        return windows.sliding_grouped(rows, sizes[0], "_anchor_id", q.group, text, ts).drop("anchor")
    window = {"TUMBLING": windows.tumbling, "HOPPING": windows.hopping, "SESSION": windows.session}[kind](*sizes, ts)
    return windows.windowed(rows, window, q.group, made)


class StreamEngine:
    """Streams are directories of Parquet micro-batches, so each query has its own offsets and survives restarts."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark).rstrip('/')}/streams-{uuid.uuid4().hex}"
        self.streams: dict[str, Stream] = {}
        self.queries: dict[str, list] = {}

    def create_stream(self, name: str, schema: str, properties: dict[str, str] | None = None, ts: str = "ts") -> Stream:
        """Declare a stream."""
        if name.lower() in self.streams:
            raise EngineError("STREAM_EXISTS", name)
        made = Stream(f"{self.root}/{name.lower()}-{next(_ids)}", T._parse_datatype_string(schema), properties or {}, ts)
        self.spark.createDataFrame([], made.schema).write.parquet(made.path)
        self.streams[name.lower()] = made
        return made

    def drop_stream(self, name: str, *, if_exists: bool = False) -> None:
        """Forget a stream and stop its queries."""
        if self.streams.pop(name.lower(), None) is None and not if_exists:
            raise EngineError("STREAM_NOT_FOUND", name)
        for q in self.queries.pop(name.lower(), []):
            q.stop()

    def _stream(self, name: str) -> Stream:
        if name.lower() not in self.streams:
            raise EngineError("STREAM_NOT_FOUND", name)
        return self.streams[name.lower()]

    def ingest(self, name: str, events: list[tuple] | DataFrame) -> None:
        """Append a micro-batch."""
        s = self._stream(name)
        rows = events if isinstance(events, DataFrame) else self.spark.createDataFrame(events, s.schema)
        rows.write.mode("append").parquet(s.path)

    def batch(self, name: str) -> DataFrame:
        """All events so far."""
        s = self._stream(name)
        return self.spark.read.schema(s.schema).option("recursiveFileLookup", "true").parquet(s.path)

    def stream(self, name: str) -> DataFrame:
        """The stream as a streaming DataFrame."""
        s = self._stream(name)
        return self.spark.readStream.schema(s.schema).option("recursiveFileLookup", "true").parquet(s.path)

    def start(self, text: str, sink: str, *, lateness: str = "0 seconds", keep_running: bool = False):
        """Run a query into a memory table: EMIT FINAL appends closed windows, EMIT CHANGES updates open ones too."""
        q = parse(text)
        out = plan(self.stream(q.source), q, self._stream(q.source).ts, lateness if q.window else None)
        mode = "append" if q.final or not any("(" in i for i in q.items) else "complete" if not q.window else "update"
        writer = out.writeStream.format("memory").queryName(sink).outputMode(mode)
        query = (writer if keep_running else writer.trigger(availableNow=True)).start()
        self.queries.setdefault(q.source.lower(), []).append(query)
        if not keep_running:
            query.awaitTermination()
        return query

    def insert_into(self, target: str, text: str, checkpoint: str) -> None:
        """INSERT INTO target SELECT ...: a continuous query whose output is another stream's input.

        A batch is written below its own number, in place of what an attempt before may have left.
        """
        q, s = parse(text), self._stream(target)
        out = plan(self.stream(q.source), q, self._stream(q.source).ts).to(s.schema)
        own = hashlib.md5(checkpoint.encode()).hexdigest()
        sink = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        sink.trigger(availableNow=True).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{s.path}/from={own}/batch={n}")).start().awaitTermination()

    def execute(self, text: str) -> DataFrame | None:
        """CREATE STREAM, DROP STREAM, or an ad-hoc query over what has come in, open windows included."""
        text = text.strip().rstrip(";")
        if m := re.match(r"CREATE\s+STREAM\s+(\w+)\s*\((.*?)\)\s*(?:WITH\s*\((.*)\))?$", text, re.I | re.S):
            cols = re.sub(r"\b(\w+)\s+(\w+)(\([^)]*\))?", lambda c: f"{c[1]} {_KINDS.get(c[2].lower(), c[2])}", m[2])
            props = dict(re.findall(r"(\w+)\s*=\s*'([^']*)'", m[3] or ""))
            self.create_stream(m[1], cols, props, props.get("timestamp", "ts"))
            return None
        if m := re.match(r"DROP\s+STREAM\s+(IF\s+EXISTS\s+)?(\w+)$", text, re.I):
            self.drop_stream(m[2], if_exists=bool(m[1]))
            return None
        q = parse(text)
        return plan(self.batch(q.source), q, self._stream(q.source).ts)
