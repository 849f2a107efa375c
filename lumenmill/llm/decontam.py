"""Benchmark decontamination by Wu-Manber search over words.

Items are cut into windows of ``window`` consecutive words (a shorter item is one window). Windows of one length form a
pattern set with three tables: a shift table over hashed blocks of two words, which says how far the search may jump; a
suffix table that lists the patterns ending in a block; and the patterns, whose words and then bytes are compared
directly. A batch of texts is searched in many equal segments at once, each with its own position, so every step of the
search is one vector operation.

Patterns are built on the driver from the item table as it streams in, in blocks of at most ``block_windows`` windows; a
longer item is spread over blocks. Each block is one broadcast of bounded size, ``PASS_BLOCKS`` of them make a pass over
the texts, and the next pass finds what those before have hit in a scratch table. A worker holds one block at a time: with
several in a pass it takes ``HELD_BYTES`` of texts, searches them for one block after the other and lets each go.

Edge cases: very long texts are searched whole; null text has no words and no hits; an item without words has no window; equal windows of several items
count for each of them; items with equal ids are one item; null item ids are left out of ``items``; repeated document
rows are searched one by one; empty tables give no rows or no hits; other columns are ignored, and kept with
``only_clean``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, bounded_batches, discard, fresh, scratch, table
from .textnp import ALNUM, Texts, mix, pieces, span_union

WINDOW = 8
#: Windows in one block of patterns.
BLOCK_WINDOWS = 500_000
#: Blocks searched for in one pass over the texts.
PASS_BLOCKS = 8
#: Bytes of text that a worker holds while it goes through several blocks.
HELD_BYTES = 64 << 20
_SHIFT_BITS = 20
#: Words searched by each of the parallel positions.
SEGMENT = 256
_MUL = np.uint64(0x9FB21C651E98DF25)


class PatternSet:
    """The Wu-Manber tables for patterns of one length in words."""

    def __init__(self, words: np.ndarray, texts: list[bytes], items: list[list[str]]):
        self.words, self.texts, self.items = words, texts, items
        self.length = words.shape[1]
        self.block = min(2, self.length)
        jump = self.length - self.block + 1
        self.shift = np.full(1 << _SHIFT_BITS, jump, np.uint8)
        for stop in range(self.block, self.length + 1):
            code = self.codes(words[:, stop - self.block : stop])
            np.minimum.at(self.shift, self.slots(code), np.uint8(self.length - stop))
        suffix = self.codes(words[:, self.length - self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def codes(self, block: np.ndarray) -> np.ndarray:
        """Hashes of blocks, one a row."""
        return block[:, 0] if self.block == 1 else mix(block[:, 0] * _MUL + block[:, 1])

    @staticmethod
    def slots(code: np.ndarray) -> np.ndarray:
        """Places in the shift table."""
        return (code >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    def search(self, words: np.ndarray, same: callable) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences in the sequence of word hashes."""
        n = len(words)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = words if self.block == 1 else np.append(np.uint64(0), mix(words[:-1] * _MUL + words[1:]))
        at = np.arange(self.length - 1, n, SEGMENT)
        stop = np.minimum(at + SEGMENT, n)
        found: list[np.ndarray] = []
        while len(at):
            jump = self.shift[self.slots(code[at])]
            if len(hits := at[jump == 0]):
                found.append(hits)
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.concatenate(found)
        low, high = np.searchsorted(self.suffix, code[ends]), np.searchsorted(self.suffix, code[ends], "right")
        ends, low, n_each = ends[high > low], low[high > low], (high - low)[high > low]
        at = np.repeat(ends, n_each) - self.length + 1
        pattern = self.order[np.repeat(low, n_each) + np.arange(len(at)) - np.repeat(np.cumsum(n_each) - n_each, n_each)]
        for k in range(self.length):
            equal = words[at + k] == self.words[pattern, k]
            at, pattern = at[equal], pattern[equal]
        equal = np.fromiter((same(a, self.length, self.texts[p]) for a, p in zip(at.tolist(), pattern.tolist(), strict=True)), bool, len(at))
        return at[equal], pattern[equal]


def _item_words(rows: list[tuple[str, str]]) -> tuple[Texts, np.ndarray]:
    texts = Texts(pa.array([text for _, text in rows], pa.large_string()))
    texts.lower()
    texts.words(ALNUM)
    return texts, texts.hash_words()


def pattern_block(rows: list[tuple[str | None, str]], window: int) -> list[PatternSet]:
    """Pattern sets, one for each window length, of the items (id, text)."""
    texts, hashes = _item_words(rows)
    data = texts.data.tobytes()
    found: dict[int, dict[tuple[bytes, ...], tuple[np.ndarray, set]]] = defaultdict(dict)
    for k, (item, _) in enumerate(rows):
        first, last = texts.bounds[k], texts.bounds[k + 1]
        size = min(window, last - first)
        if not size:
            continue
        words = [data[texts.starts[i] : texts.ends[i]] for i in range(first, last)]
        for i in range(len(words) - size + 1):
            held = found[int(size)].setdefault(tuple(words[i : i + size]), (hashes[first + i : first + i + size], set()))
            if item is not None:
                held[1].add(item)
    return [
        PatternSet(np.array([h for h, _ in p.values()]), [b" ".join(k) for k in p], [sorted(s) for _, s in p.values()])
        for p in found.values()
    ]


def _spread(text: str, window: int, most: int) -> Iterator[str]:
    """An item's text, in overlapping parts of at most ``most`` windows if it has more."""
    if len(text) // 2 < most:
        yield text
        return
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))
    if len(words) <= window:
        yield text
    for i in range(0, len(words) - window + 1 if len(words) > window else 0, most):
        yield " ".join(words[i : i + most + window - 1])


def pattern_blocks(items: DataFrame, window: int, block_windows: int) -> Iterator[list[PatternSet]]:
    """Blocks of pattern sets, as the item table streams in."""
    rows, held = [], 0
    for item, text in items.selectExpr("cast(item_id as string)", "text").toLocalIterator():
        for part in _spread(text or "", window, block_windows):
            if not part:
                continue
            rows.append((item, part))
            held += 1 + part.count(" ")
            if held >= block_windows:
                yield pattern_block(rows, window)
                rows, held = [], 0
    if rows:
        yield pattern_block(rows, window)


class Search:
    """A piece of texts and what has been found in it: hit words and items of each text."""

    def __init__(self, texts: Texts):
        texts.lower()
        texts.words(ALNUM)
        self.texts, self.count = texts, np.diff(texts.bounds)
        # a word of hash 0 after each text keeps windows from running on into the next
        gaps = np.repeat(np.arange(texts.n), self.count)
        self.words = np.zeros(len(texts.starts) + texts.n, np.uint64)
        self.words[np.arange(len(texts.starts)) + gaps] = texts.hash_words()
        self.first, self.ends = texts.bounds[:-1] + np.arange(texts.n), texts.bounds[1:] + np.arange(texts.n)
        self.items: list[set[str]] = [set() for _ in range(texts.n)]
        self.hit = np.zeros(len(self.words), bool)

    def same(self, at: int, size: int, pattern: bytes) -> bool:
        """Whether the words from ``at`` on are the pattern's, compared as bytes."""
        first = at - int(np.searchsorted(self.ends, at, "right"))
        s, e = self.texts.starts[first : first + size], self.texts.ends[first : first + size]
        return b" ".join(self.texts.data[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)) == pattern

    def block(self, sets: list[PatternSet]) -> None:
        """Search for one block of patterns."""
        for patterns in sets:
            at, which = patterns.search(self.words, self.same)
            self.hit |= span_union(at, at + patterns.length, len(self.words))
            of = np.searchsorted(self.ends, at, "right")
            for k in np.unique(of * len(patterns.texts) + which).tolist():
                self.items[k // len(patterns.texts)].update(patterns.items[k % len(patterns.texts)])

    def earlier(self, hits: list[list[int]], items: list[list[str]]) -> None:
        """Take up what passes before have found."""
        for k, (places, names) in enumerate(zip(hits, items, strict=True)):
            self.hit[self.first[k] + np.array(places, np.int64)] = True
            self.items[k].update(names)

    def places(self) -> list[np.ndarray]:
        """The hit words of each text."""
        return [np.flatnonzero(self.hit[a:b]) for a, b in zip(self.first.tolist(), self.ends.tolist(), strict=True)]

    def n_hit(self) -> np.ndarray:
        """How many words of each text are hit."""
        total = np.append(0, np.cumsum(self.hit))
        return total[self.ends] - total[self.first]


def _searched(batches: Iterator[pa.RecordBatch], sent: list[Broadcast], hits: str, names: str) -> Iterator[tuple[pa.RecordBatch, Search]]:
    """The pieces of the batches with what the blocks sent, and passes before, find in them."""
    held: list[tuple[pa.RecordBatch, Search]] = []

    def through() -> Iterator[tuple[pa.RecordBatch, Search]]:
        for block in sent:
            for _, search in held:
                search.block(block.value)
            if len(sent) > 1 and getattr(block, "_path", None):
                block.__dict__.pop("_value", None)  # read again from the worker's file when it is next wanted
        yield from held
        held.clear()

    size = 0
    for batch in batches:
        for part, texts in pieces(batch, "text"):
            search = Search(texts)
            if hits in part.schema.names:
                search.earlier(part.column(hits).to_pylist(), part.column(names).to_pylist())
            held.append((part, search))
            size += len(texts.data)
            if len(sent) < 2 or size >= HELD_BYTES:
                yield from through()
                size = 0
    yield from through()


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, min_items: int = 2, block_windows: int = BLOCK_WINDOWS, only_clean: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, items (ids, sorted), contaminated; or, with ``only_clean``, the clean rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    hits, names = fresh(docs, "_hits", "_items")
    carried = docs.columns if only_clean else ["doc_id"]
    schema = T.StructType([docs.schema[c] for c in carried])
    if not only_clean:
        schema = schema.add("n_words", T.LongType()).add("n_hit", T.LongType())
        schema = schema.add("items", T.ArrayType(T.StringType())).add("contaminated", T.BooleanType())
        docs = docs.select("doc_id", "text")
    own_columns = docs.columns
    between = T.StructType(list(docs.schema.fields)).add(hits, T.ArrayType(T.IntegerType())).add(names, T.ArrayType(T.StringType()))

    def last(sent: list[Broadcast]) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, search in _searched(batches, sent, hits, names):
                bad = pa.array([len(x) >= min_items for x in search.items])
                own = part.select(carried)
                if only_clean:
                    yield own.filter(pc.invert(bad))
                    continue
                listed = pa.array([sorted(x) for x in search.items], pa.list_(pa.string()))
                arrays = [*own.columns, pa.array(search.count.astype(np.int64)), pa.array(search.n_hit().astype(np.int64)), listed, bad]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        return run

    def more(sent: list[Broadcast]) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, search in _searched(batches, sent, hits, names):
                found = [pa.array(search.places(), pa.list_(pa.int32())), pa.array([sorted(x) for x in search.items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.select(own_columns).columns, *found], names=[*own_columns, hits, names])

        return run

    rows, written = docs, None
    passes = batched(pattern_blocks(items, window, block_windows), PASS_BLOCKS)
    group = next(passes, ())
    while True:
        sent = [spark.sparkContext.broadcast(b) for b in group]
        group = next(passes, None)
        if group is None:
            return rows.mapInArrow(last(sent), schema)
        rows = scratch(rows.mapInArrow(more(sent), between), "hits")
        for b in sent:
            b.destroy()
        if written is not None:
            discard(written)
        written = rows


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(8, len(ws)) AS n, unnest([array_to_string(ws[i : i + least(8, len(ws)) - 1], ' ')
    FOR i IN range(1, len(ws) - least(8, len(ws)) + 2)]) AS pat FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM p),
pats AS (SELECT DISTINCT n, pat FROM p),
w AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest([array_to_string(ws[i : i + n - 1], ' ')
    FOR i IN range(1, len(ws) - n + 2)]) AS pat FROM d, sizes WHERE len(ws) >= n),
h AS (SELECT doc_id, i, n, pat FROM w SEMI JOIN pats USING (n, pat)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM h JOIN p USING (n, pat) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
