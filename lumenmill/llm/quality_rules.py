"""Quality rules on repetition, found with a suffix array over words.

Suffixes of each text are sorted by prefix doubling on word ranks; only suffixes that still tie are sorted again. The
longest common prefix of neighbours in that order follows from the ranks of the doubling levels. A word position whose
neighbours share a prefix of L words starts a repeated substring of L words, and the union of those spans is what the
maximal repeats (the intervals of the LCP array) cover.

A text is kept when it has at least 50 words, at most half of them lie in repeated 3-word windows, repeats of
``MIN_REPEAT`` words or more cover at most ``MAX_COVERED`` percent of its words, and the longest repeat is at most
``MAX_LONGEST`` percent of it.

Words are compared by 64-bit hashes (exact up to eight bytes), duplicate lines by their bytes. A text's suffix array lives
in one task, in memory of about 50 bytes a word.

Edge cases: null or empty text has no words and is rejected; very long texts are judged whole; rows are judged one by one, so ties and repeated rows give
equal verdicts; an empty table gives no rows; null ids are kept as they are; of clashing column names this operator's
are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, table
from .textnp import BLANK, Texts, mix, pieces, span_union, table_of

MIN_WORDS, MAX_WINDOW_SHARE, WINDOW = 50, 50, 3
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 40, 30
#: Words of an input whose levels are all kept.
DENSE = 1 << 20
_SYMBOL = table_of(b"#*$%&|<>")
_SALT = np.uint64(0xD6E8FEB86659FD93)
FIELDS = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "n_covered": T.LongType(), "longest_repeat": T.LongType(),
    "base_failed": T.BooleanType(), "kept": T.BooleanType(),
}


def longest_repeats(keys: np.ndarray) -> np.ndarray:
    """For each position of the sequence, how many items from it on also occur, in the same order, elsewhere.

    Equal items have equal keys; keys of different texts differ, so no match runs across texts.
    """
    n = len(keys)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    opens = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=opens[1:])
    group = np.flatnonzero(opens)
    kind = np.int32 if n < 1 << 31 else np.int64
    rank = np.empty(n, kind)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    # every level is kept of short inputs, every fourth of long ones: the same answer from a quarter of the memory
    apart = 1 if n < DENSE else 4
    levels, doubled = [rank], 0
    tied = np.repeat(np.diff(np.append(group, n)) > 1, np.diff(np.append(group, n)))
    active, step = order[tied], 1
    while len(active):
        ahead = active + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n + active)
        code = rank[active].astype(np.int64) * (2 * n) + second
        within = np.argsort(code)
        active, code = active[within], code[within]
        old = rank[active]
        opens = np.ones(len(active), bool)
        np.not_equal(code[1:], code[:-1], out=opens[1:])
        at = np.flatnonzero(opens)
        lengths = np.diff(np.append(at, len(active)))
        base = np.ones(len(active), bool)
        np.not_equal(old[1:], old[:-1], out=base[1:])
        slots = np.arange(len(active)) - np.repeat(np.flatnonzero(base), np.diff(np.append(np.flatnonzero(base), len(active))))
        rank = rank.copy()
        rank[active] = np.repeat((old + slots)[at], lengths)
        doubled += 1
        if doubled % apart == 0:
            levels.append(rank)
        active, step = active[np.repeat(lengths > 1, lengths)], step * 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    pair = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[pair], right[pair]
    shared = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range((1 << apart) - 1):
            x, y = a + shared, b + shared
            inside = (x < n) & (y < n)
            same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
            shared[same] += 1 << k * apart
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    return longest


def _dup_lines(t: Texts) -> np.ndarray:
    newline = np.flatnonzero(t.data == 10)
    starts = np.union1d(t.offsets[:-1], newline + 1)
    starts = starts[starts < len(t.data)]
    text = np.searchsorted(t.offsets, starts, "right") - 1
    following = np.append(newline, len(t.data))[np.searchsorted(newline, starts)]
    ends = np.minimum(following, t.offsets[text + 1])
    with_word = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends, text = starts[with_word], ends[with_word], text[with_word]
    keys = mix(t.hash_spans(starts, ends) + text.astype(np.uint64) * _SALT)
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1]) + 1
    raw = memoryview(np.ascontiguousarray(t.data))
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    for k in again.tolist():  # an equal hash is confirmed on the lines themselves
        (a, b), (c, d) = spans[order[k - 1]], spans[order[k]]
        if raw[a:b] != raw[c:d]:
            lines = [(i, bytes(raw[x:y])) for i, (x, y) in zip(text.tolist(), spans, strict=True)]
            return np.bincount(text, minlength=t.n) - np.bincount([i for i, _ in set(lines)], minlength=t.n)
    return np.bincount(text[order[again]], minlength=t.n)


def measure(t: Texts) -> dict[str, np.ndarray]:
    """All fields for the texts of a piece."""
    t.words(~BLANK)
    n_words = np.diff(t.bounds)
    text = np.repeat(np.arange(t.n), n_words)
    longest = longest_repeats(mix(t.hash_words() + text.astype(np.uint64) * _SALT))
    total = len(text)

    def covered(least: int, whole: bool) -> np.ndarray:
        at = np.flatnonzero(longest >= least)
        union = span_union(at, at + (longest[at] if whole else least), total)
        return np.bincount(text[union], minlength=t.n)

    top = np.zeros(t.n, np.int64)
    np.maximum.at(top, text, longest)
    out = {
        "n_words": n_words,
        "word_chars": t.per_text(t.inside & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.per_text(_SYMBOL[t.data]),
        "n_dup_lines": _dup_lines(t),
        "n_repeat_words": covered(WINDOW, False),
        "n_covered": covered(MIN_REPEAT, True),
        "longest_repeat": top,
    }
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_WINDOW_SHARE * n_words)
    over = (100 * out["n_covered"] > MAX_COVERED * n_words) | ((top >= MIN_REPEAT) & (100 * top > MAX_LONGEST * n_words))
    out["kept"] = ~out["base_failed"] & ~over
    return out


def quality_rules(docs: DataFrame, *, only_kept: bool = False) -> DataFrame:
    """``docs`` with the measures and the verdict; with ``only_kept``, the kept rows of ``docs`` in their own columns."""
    bounded_batches(docs.sparkSession)
    carried = docs.columns if only_kept else [c for c in docs.columns if c not in FIELDS and c != "text"]
    schema = T.StructType([docs.schema[c] for c in carried])
    if not only_kept:
        for k, v in FIELDS.items():
            schema = schema.add(k, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                found = measure(texts)
                own = part.select(carried)
                if only_kept:
                    yield own.filter(pa.array(found["kept"]))
                    continue
                arrays = [pa.array(v if v.dtype == bool else v.astype(np.int64)) for v in found.values()]
                yield pa.RecordBatch.from_arrays([*own.columns, *arrays], names=[*carried, *found])

    return docs.mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_covered", "longest_repeat")


OP6_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 1)) AS i, unnest([ws[i : i + 2] FOR i IN range(1, len(ws) - 1)]) AS x FROM w WHERE len(ws) >= 3
), g2 AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), b AS MATERIALIZED (
  SELECT w.doc_id, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
), t AS (  -- ten-word windows cover repeats of ten words or more
  SELECT doc_id, unnest(range(1, n_words - 8)) AS i, unnest([ws[i : i + 9] FOR i IN range(1, n_words - 8)]) AS x FROM b WHERE NOT base_failed
), t2 AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM t) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_covered FROM (SELECT doc_id, unnest(range(i, i + 10)) AS p FROM t2) GROUP BY doc_id
), lim AS (  -- the longest repeat is too long where a window of one word more than allowed is found twice
  SELECT doc_id, ws, n_words, greatest(10, 30 * n_words // 100 + 1) AS size FROM b SEMI JOIN t2 USING (doc_id)
), u AS (
  SELECT doc_id, md5(unnest([array_to_string(ws[i : i + size - 1], ' ') FOR i IN range(1, n_words - size + 2)])) AS h FROM lim WHERE n_words >= size
), long AS (
  SELECT doc_id FROM u GROUP BY doc_id HAVING count(*) > count(DISTINCT h)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * coalesce(n_covered, 0) <= 40 * n_words AND long.doc_id IS NULL AS kept
FROM b LEFT JOIN cov USING (doc_id) LEFT JOIN long USING (doc_id)
"""
