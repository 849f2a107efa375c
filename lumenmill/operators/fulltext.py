"""Inverted-index full-text search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def build_index(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Postings (term, key): one row a document and term."""
    text = F.concat_ws(" ", *cols)
    return df.select(key, F.explode(F.array_distinct(tokens(text))).alias("term"))


def match_any(df: DataFrame, key: str, cols: list[str], query: str, index: DataFrame | None = None) -> DataFrame:
    """Documents with any of the terms: score = sum of 1 + ln(N / df) over the terms found.

    With an index, only postings of the query's terms are read and aggregated. Without one, each term is a test on the
    row; the counts are one row, and nothing is exploded or shuffled.
    """
    terms = sorted({t for t in re.findall(r"[^\W_]+", query.lower())})
    if index is None:
        text = F.lower(F.concat_ws(" ", *cols))
        whole = lambda t: text.contains(t) & text.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(t)}(?![\p{{L}}\p{{N}}])")  # noqa: E731  a plain search first
        x = df.select(key, *[whole(t).alias(f"_h{k}") for k, t in enumerate(terms)])
        counts = x.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"_h{k}").cast("long")).alias(f"_d{k}") for k in range(len(terms))])
        score = reduce(lambda a, b: a + b, [F.when(F.col(f"_h{k}"), 1 + F.log(F.col("_n") / F.col(f"_d{k}"))).otherwise(0.0) for k in range(len(terms))], F.lit(0.0))
        return x.crossJoin(F.broadcast(counts)).select(key, score.alias("relevance")).where("relevance > 0")  # counts: one row
    postings = index.where(F.col("term").isin(terms))
    n = df.agg(F.count(F.lit(1)).alias("n_docs"))
    weights = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    weights = weights.select("term", (1 + F.log(F.col("n_docs") / F.col("df"))).alias("w"))  # a row a query term
    return postings.join(F.broadcast(weights), "term").groupBy(key).agg(F.sum("w").alias("relevance"))


def match_contains(df: DataFrame, cols: list[str], query: str) -> DataFrame:
    """Without an index: rows that contain a term as a substring; score = number of terms."""
    text = F.lower(F.concat_ws(" ", *cols))
    terms = sorted(set(query.lower().split()))
    score = reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms], F.lit(0))
    return df.withColumn("relevance", score).where("relevance > 0")


def match_boolean(df: DataFrame, cols: list[str], query: str) -> DataFrame:
    """Boolean mode: +required, -excluded, "phrase", optional terms; substrings of the lower-cased text."""
    text = F.lower(F.concat_ws(" ", *cols))
    phrases = re.findall(r'"([^"]+)"', query.lower())
    words = re.sub(r'"[^"]*"', " ", query.lower()).split()
    must = [w[1:] for w in words if w[0] == "+" and len(w) > 1] + phrases
    never = [w[1:] for w in words if w[0] == "-" and len(w) > 1]
    may = [w for w in words if w[0] not in "+-"]
    cond = reduce(lambda a, b: a & b, [text.contains(t) for t in must], F.lit(True))
    cond = reduce(lambda a, b: a & ~b, [text.contains(t) for t in never], cond)
    if may and not must:
        cond = cond & reduce(lambda a, b: a | b, [text.contains(t) for t in may])
    return df.where(cond)
