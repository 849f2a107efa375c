"""Mixing sources to target weights by weighted fair queueing, with DataFrame expressions only.

Every document is shuffled inside its source by a hash. A copy of a document gets a virtual start and finish time: the
source's words before and through it (earlier copies of the whole source included), divided by the source's target. All
copies that start before virtual time 1, when every source has had its target, stand in one global order by finish time;
a running total of words goes along that order, and where it reaches the budget the mix ends, inside a document if need
be. What a query takes from a document and what :func:`emit` returns are the rows before that cut.

Texts are read once for their sizes; the order is found on (id, source, size) rows, written to the shared folder, and
texts are joined back once. No running total puts a source or the whole order into one task: totals are taken inside
cells (ranges of the shuffle key in a source, ranges of finish time over all), whose number grows with the rows, and cell
totals are added up over one row a cell. Ranges of finish time hold about equal words, as the queue serves at one rate.

Edge cases: null text has size 0; the null source is a source of its own, last in order; documents of size 0 are taken
0 times; rows equal in every column are scheduled one after the other and share a place in the shuffle, rows with equal
ids and other texts are separate documents; a null id is shuffled as the empty string; very long texts may be cut only by
the end of the mix; all sizes 0 or an empty table gives targets of 0 and an empty mix; other columns are kept by
:func:`emit`, but for those named as its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, discard, fresh, scratch, table

#: Rows that a cell holds on average, at most.
CELL_ROWS = 20_000
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MAX_EPOCHS = 3
#: What ties in finish time are broken by: all that names a copy.
ORDER = ("finish", "source", "key", "size", "nth", "copy")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source.

    With sources sorted by cap per weight, the level of each is what it and all later ones get per unit of weight once
    those before it are capped. Levels rise as long as sources are capped and fall after that, so the largest counts.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = F.lit(float(max_epochs)) * F.col("source_size")
    x = sizes.withColumn("w", weight).withColumn("cap", limit)
    before = W.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = x.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    level = F.max("level").over(everything)
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def shuffle_key(seed: str) -> Column:
    """A document's place inside its source: a hash of its id and text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed), *own).cast("binary"))


def row_hash(docs: DataFrame) -> Column:
    """Tells rows apart that are equal in id, source and text but not in other columns."""
    kinds = (T.MapType, T.VariantType)
    return F.xxhash64(*[c.name for c in docs.schema.fields if not isinstance(c.dataType, kinds)])


def _hex_digits(rows: int) -> int:
    """Hex digits of the shuffle key that keep a cell at ``CELL_ROWS`` rows."""
    digits = 1
    while rows > CELL_ROWS << 4 * digits:
        digits += 1
    return digits


def _before(rows: DataFrame, group: list[str], cell: str, order: list[Column], words: Column, name: str) -> DataFrame:
    """Adds the words before each row: a running total inside its cell, and the totals of the cells before."""
    inside = W.partitionBy(*group, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy(*group, cell).agg(F.sum(words).alias("_words"))
    earlier = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    names = {c: f"_c_{c}" for c in (*group, cell)}
    cells = cells.withColumn("_earlier", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words").withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in names.items()]
    out = rows.withColumn("_inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(cells, same)
    return out.withColumn(name, F.col("_inside") + F.col("_earlier")).drop("_inside", "_earlier", *names.values())


def schedule(docs: DataFrame, seed: str = "", other: Column | None = None) -> DataFrame:
    """(doc_id, source, key, other, size, same, source_size, target, before), one row for ``same`` equal rows of ``docs``.

    ``before`` is the words of the source that the shuffle puts before the first of them. Backed by a scratch table.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", shuffle_key(seed).alias("key"), (F.lit(0).cast("long") if other is None else other).alias("other"), size.alias("size"))
    sized = scratch(rows, "sizes")
    cell = F.substring("key", 1, _hex_digits(sized.count()))
    x = sized.groupBy("doc_id", "source", "key", "other", "size").agg(F.count(F.lit(1)).alias("same")).withColumn("cell", cell)
    words = F.col("size") * F.col("same")
    out = _before(x, ["source"], "cell", [F.col("key"), F.col("size"), F.col("other")], words, "before").drop("cell")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "_source")
    out = out.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    out._scratch = sized._scratch
    return out


def queued(scheduled: DataFrame) -> DataFrame:
    """The copies (doc_id, source, key, other, size, nth, copy, finish, take) of the mix: those before the budget's end.

    ``nth`` counts the equal rows of a schedule's row, ``copy`` the earlier epochs of the source.
    """
    start = F.col("copy") * F.col("source_size") + F.col("before") + F.col("nth") * F.col("size")
    epochs = F.sequence(F.lit(0).cast("long"), F.floor(F.col("target") / F.col("source_size")))
    x = scheduled.where("size > 0").withColumn("copy", F.explode(epochs)).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1)))
    x = x.withColumn("start", start).where(F.col("start") < F.col("target"))
    x = x.withColumn("finish", (F.col("start") + F.col("size")) / F.col("target"))
    x = x.select("doc_id", "source", "key", "other", "size", "nth", "copy", "finish")
    whole = scheduled.agg(F.coalesce(F.sum(F.col("size") * F.col("same")), F.lit(0)).alias("budget"), F.sum("same").alias("rows")).first()
    cells = max(1, (whole["rows"] or 0) // CELL_ROWS)
    x = x.withColumn("cell", F.floor(F.least("finish", F.lit(1.0)) * cells))
    order = [F.col(c).asc_nulls_last() for c in ORDER]
    x = _before(x, [], "cell", order, F.col("size"), "served").drop("cell")
    left = F.lit(whole["budget"]).cast("long") - F.col("served")
    return x.where(left > 0).withColumn("take", F.least("size", left)).drop("served")


def emit(docs: DataFrame, seed: str = "") -> DataFrame:
    """The mix in its order: a row for each copy taken, with ``copy``, ``finish`` and ``take`` (words of it to use)."""
    docs = docs.drop("copy", "finish", "take")
    own, place, nth, key, other, whole, same = fresh(docs, "_id", "_row", "_nth", "_key", "_other", "_whole", "_same")
    taken = queued(schedule(docs, seed, row_hash(docs)))
    taken = taken.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("other").alias(other), F.col("nth").alias(nth), "copy", "finish", "take")
    # rows equal in all columns stand for each other: one of them is joined to all copies
    texts = docs.withColumn(place, shuffle_key(seed)).withColumn(whole, row_hash(docs))
    first = W.partitionBy(place, whole).orderBy(F.lit(0))
    texts = texts.withColumn(same, F.row_number().over(first)).where(F.col(same) == 1)
    out = texts.join(taken, (F.col(place) == F.col(key)) & (F.col(whole) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(own)))
    out = out.orderBy("finish", F.col("source").asc_nulls_last(), place, nth, "copy")
    return out.drop(own, place, nth, key, other, whole, same)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document."""
    plan = schedule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    kept = scratch(plan, "schedule")
    discard(plan)
    names = ["doc_id", "source", "key", "nth"]
    sums = queued(kept).groupBy(*names).agg(F.sum("take").alias("taken")).withColumnsRenamed({c: f"_{c}" for c in names})
    rows = kept.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return rows.join(sums, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), g AS (
  SELECT source, source_size, total, least(cap, w * (SELECT max(level) FROM l)) AS target FROM l
), x AS (
  SELECT d.*, g.source_size, g.target, g.total, row_number() OVER () AS row,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT *, unnest(range(4)) AS copy FROM x WHERE size > 0
), q AS (
  SELECT *, (copy * source_size + before + size)::DOUBLE / target AS finish FROM e WHERE copy * source_size + before < target
), r AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, k, size, before, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS served FROM q
), t AS (
  SELECT row, sum(greatest(0, least(size, total - served)))::BIGINT AS taken FROM r GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM x LEFT JOIN t USING (row)
"""
