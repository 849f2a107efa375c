"""Line dedup with DataFrame expressions only.

Hashes of line keys (128 bits) are range-partitioned and sorted inside each range by document and position, so first
occurrences are read off as the sorted rows stream by. A hot key is spread over ``salts`` ranges by document; the
salted groups hold one row each in the step that joins them, so no task ever gets a whole hot key. What travels per
document is a compressed keep bitmap: one bit a line, up to the last word with a dropped line, and none for documents that
lose nothing. Work is linear in a document's lines, so that very long texts cost no more a line than others.

Edge cases: null or empty text is one empty line; an empty key (blank line) is never dropped; rows are named by
(doc_id, hash of the text), and a null id is one id; repeated rows count as one document and are each returned; an empty
table gives no rows; other columns are kept by :func:`apply_bitmaps`, but for those named as its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh, scratch, table

SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _all() -> Column:
    """Keep bits of 64 lines that all stay."""
    return F.lit(-1).cast("long")


def _row_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, salts: int = SALTS) -> DataFrame:
    """(doc_id, row_hash, drops): bitmaps of the rows that lose lines. ``drops`` has the keep bits of 64 lines a word, up
    to the last word with a dropped line.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines: all of them,
    or, with ``keep_first``, all but the first by document and position.
    """
    # the text is hashed below the explosion: above it, it would be hashed once a line
    lines = docs.select("doc_id", _row_hash().alias("row_hash"), _lines(F.col("text")).alias("lines"))
    lines = lines.select("doc_id", "row_hash", F.posexplode("lines").alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = lines.withColumn("key", key).where(F.char_length("key") >= max(1, min_chars)).select(
        "doc_id", "row_hash", "pos",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    # the texts are split and hashed once; range sampling and both uses below read the hashes
    hashed = scratch(lines, "line-hashes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = hashed.repartitionByRange(n, "h1", "h2", "salt")
    group = W.partitionBy("h1", "h2", "salt")
    stream = group.orderBy("doc_id", "pos", "row_hash")
    fresh = F.row_number().over(stream) == 1
    new_doc = fresh | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream))
    lines = lines.withColumn("first", fresh).withColumn("new_doc", new_doc)
    salted = lines.groupBy("h1", "h2", "salt").agg(
        F.sum(F.col("new_doc").cast("long")).alias("n"),
        F.min(F.struct("doc_id", "pos", "row_hash")).alias("head"),
    )
    whole = W.partitionBy("h1", "h2")
    hot = (
        salted.withColumn("docs", F.sum("n").over(whole))
        .withColumn("opens", F.col("head") == F.min("head").over(whole))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "salt", "opens")
    )
    dropped = lines.join(hot, ["h1", "h2", "salt"])
    if keep_first:
        dropped = dropped.where(~(F.col("first") & F.col("opens")))
    # two steps under one partitioning: bits of a 64-line word, then the words of a row
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = (
        dropped.repartition("doc_id", "row_hash").groupBy("doc_id", "row_hash", F.shiftright("pos", 6).alias("word"))
        .agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
        .groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )
    earlier = F.concat(F.array(F.lit(-1)), F.transform("words", lambda w: w["word"]))
    filled = F.zip_with("words", earlier, lambda w, e: F.when(w.isNotNull(), F.concat(F.array_repeat(_all(), w["word"] - e - 1), F.array(w["bits"]))))
    return words.select("doc_id", "row_hash", F.flatten(F.filter(filled, lambda w: w.isNotNull())).alias("drops"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    own_hash, own_id, mark, drops, left = fresh(docs, "_hash", "_id", "_mark", "_drops", "_kept")
    marks = bitmaps.select(F.col("doc_id").alias(own_id), F.col("row_hash").alias(mark), F.col("drops").alias(drops))
    x = docs.withColumn(own_hash, _row_hash()).join(
        marks, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(own_hash) == F.col(mark)), "left"
    )
    lines = _lines(F.col("text"))

    def kept(line: Column, i: Column) -> Column:
        del line
        return F.getbit(F.coalesce(F.get(F.col(drops), F.shiftright(i, 6)), _all()), i % 64) == 1

    x = x.withColumn(left, F.when(F.col(drops).isNotNull(), F.filter(lines, kept)))
    return (
        x.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.col("n_lines") - F.size(left), F.lit(0).cast("long")))
        .withColumn("kept_text", F.coalesce(F.array_join(left, "\n"), F.col("text"), F.lit("")))
        .drop(own_id, mark, own_hash, left, drops)
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is in at least 10 documents go from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (WHERE gone)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
