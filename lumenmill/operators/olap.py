"""Grouping sets, pivoting, hierarchies and window shapes."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenmill.operators.dml import EngineError
from lumenmill.sources.shared import cut

_AGGREGATES = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def rollup_sets(cols: list[str]) -> list[tuple[str, ...]]:
    """The prefixes of the columns, longest first."""
    return [tuple(cols[:k]) for k in range(len(cols), -1, -1)]


def cube_sets(cols: list[str]) -> list[tuple[str, ...]]:
    """All subsets of the columns."""
    return [c for k in range(len(cols), -1, -1) for c in combinations(cols, k)]


def grouping_sets(df: DataFrame, sets: Iterable[Iterable[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregate once per set in a single scan; columns outside a set are null."""
    sets = [list(s) for s in sets]
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(*aggregates)


def pivot(df: DataFrame, keep: list[str], by: str, values: list, aggregate: str, column: str, *, null_counts: bool = True) -> DataFrame:
    """PIVOT(aggregate(column) FOR by IN values): one column a value; cells without rows are null."""
    cell = _AGGREGATES[aggregate.upper()](F.col(column))
    out = df.groupBy(*keep).pivot(by, values).agg(cell)
    if aggregate.upper() == "COUNT" and null_counts:
        out = out.withColumns({str(v): F.nullif(F.col(f"`{v}`"), F.lit(0)) for v in values})
    return out


def unpivot(df: DataFrame, keep: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """UNPIVOT(value FOR name IN columns); null cells are left out."""
    return df.unpivot(keep, columns, name, value).where(F.col(value).isNotNull())


def connect_by(df: DataFrame, node: str, parent: str, start: Column, *, max_depth: int = 1000) -> DataFrame:
    """Rows reachable from the start rows by parent links, with ``level`` and ``path``; cycles are cut by the path.

    Level by level: each step joins only the last level, so the work follows the size of the result, and each level is
    written to the shared folder, so plans don't grow. A deeper hierarchy is an error.
    """
    path = F.array(F.col(node))
    out = level = df.where(start).withColumn("level", F.lit(1)).withColumn("path", path)
    for depth in range(2, max_depth + 1):
        above = level.select(F.col(node).alias("_up"), F.col("path").alias("_path"))
        step = df.join(above, (F.col(parent) == F.col("_up")) & ~F.array_contains("_path", F.col(node)))
        level = cut(step.select(*df.columns, F.lit(depth).alias("level"), F.array_append("_path", F.col(node)).alias("path")), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise EngineError("RECURSION_LIMIT", f"the hierarchy is deeper than {max_depth} levels")


def running(partition: list[str], order: list[Column]) -> W:
    """ROWS UNBOUNDED PRECEDING .. CURRENT ROW."""
    return W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def moving(partition: list[str], order: list[Column], before: int, after: int = 0) -> W:
    """ROWS before PRECEDING .. after FOLLOWING."""
    return W.partitionBy(*partition).orderBy(*order).rowsBetween(-before, after)


def recursive_fixpoint(seed: DataFrame, step, *, max_rounds: int = 1000) -> DataFrame:
    """The union of seed, step(seed), step(step(seed)) ... with set semantics, to a fixpoint; none within ``max_rounds`` is an error."""
    total = last = cut(seed.distinct(), "round")
    for _ in range(max_rounds):
        last = cut(step(last).distinct().join(total, on=total.columns, how="left_anti"), "round")
        if last.isEmpty():
            return total
        total = total.unionByName(last)
    raise EngineError("RECURSION_LIMIT", f"no fixpoint after {max_rounds} rounds")
