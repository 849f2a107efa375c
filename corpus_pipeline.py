"""The corpus pipeline: raw documents to a training mix, in five stages that are each written and read again.

Edge cases: null and empty texts are rejected by the first stage; very long texts pass whole; a null id is never a copy of
another document; rows equal in id and text are one document from near-dedup on; rows of equal ids with other texts are
different documents; empty tables give an empty mix; other columns are kept, but for ``copy``, ``finish`` and ``take``, which
the mix adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import decontam, linededup, minhash, mixing, quality_rules
from lumenmill.llm.common import scratch, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality_rules.quality_rules(docs, only_kept=True)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line found in 10 documents or more stays where it comes first. Documents left without text go."""
    marks = linededup.keep_bitmaps(docs.select("doc_id", "text"), min_docs=10, min_chars=1, keep_first=True)
    out = linededup.apply_bitmaps(docs, marks).where((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    n_chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    return out.withColumns({"text": text, "n_chars": n_chars}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of at least one benchmark item go."""
    return decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), min_items=1, only_clean=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each copy taken, with the words of it to use."""
    return mixing.emit(docs).drop("before")


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: SQL can't express the suffix array's verdict within reason; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
