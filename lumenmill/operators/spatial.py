"""Points and distances in the plane."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of either side in a block of a crowded cell, candidates for a partition, and partitions at most.
_BLOCK, _SHARE, _MOST = 4096, 1 << 25, 20_000


def point(x: Column | float, y: Column | float) -> Column:
    """A point as a struct of two doubles."""
    x, y = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def parse_point(text: Column) -> Column:
    """POINT(x, y) or POINT(x y) as a point; null if it is neither."""
    m = F.lit(r"(?i)^\s*POINT\s*\(\s*(-?[\d.]+)[\s,]+(-?[\d.]+)\s*\)\s*$")
    x, y = (F.regexp_extract(text, r"(?i)^\s*POINT\s*\(\s*(-?[\d.]+)[\s,]+(-?[\d.]+)\s*\)\s*$", k) for k in (1, 2))
    return F.when(F.regexp_like(text, m), point(x, y))


def st_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))


def st_within(df: DataFrame, column: str, x: float, y: float, radius: float) -> DataFrame:
    """Rows within a radius. The bounding box is tested first: it needs no square root."""
    c = F.col(column)
    box = c["x"].between(x - radius, x + radius) & c["y"].between(y - radius, y + radius)
    return df.where(box & (st_distance(c, point(x, y)) <= radius))


def st_contains(box_low: Column, box_high: Column, p: Column) -> Column:
    """Whether a rectangle contains a point."""
    return p["x"].between(box_low["x"], box_high["x"]) & p["y"].between(box_low["y"], box_high["y"])


def distance_join(left: DataFrame, right: DataFrame, l_col: str, r_col: str, radius: float) -> DataFrame:
    """Pairs within a radius by grid cells: an equi-join on the cell and its neighbours, then the exact test.

    Neither side is broadcast. The rows of a cell are counted first: a crowded cell is cut into blocks of both sides, each
    of which meets each, and there are as many partitions as the candidates ask for, as their number grows with the square
    of what a cell holds.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    size, key = radius * (1 + 2**-20), ["_cx", "_cy"]  # wider by more than quotients are rounded, or pairs at the radius may lie two cells apart
    cell = lambda c: {f"_c{k}": F.floor(F.col(c)[k] / size) for k in "xy"}
    near = F.array(*[F.struct(F.lit(i).cast("long").alias("x"), F.lit(j).cast("long").alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumns(cell(l_col)).withColumn("_near", F.explode(near))
    a = a.withColumns({f"_c{k}": F.try_add(f"_c{k}", F.col("_near")[k]) for k in "xy"}).drop("_near")  # null beyond the last cell
    b = right.withColumns(cell(r_col))
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    cells = count(a, "_na").join(count(b, "_nb").hint("merge"), key)
    pairs = cells.agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(pairs / _SHARE), _MOST))
    # one row for each _BLOCK rows at most
    crowded = F.broadcast(cells.where(F.greatest("_na", "_nb") > _BLOCK).select(*key, *[F.ceil(F.col(c) / _BLOCK).alias(c) for c in ("_na", "_nb")]))

    def blocks(df: DataFrame, own: str, other: str, at: str, meets: str) -> DataFrame:
        """Rows with the block that they are in, once for each block that they meet."""
        mixed = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.coalesce(own, F.lit(1)))
        df = df.join(crowded, key, "left").withColumns({at: mixed, meets: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))})
        return df.drop("_na", "_nb").repartition(n, *key, "_i", "_j")

    a, b = blocks(a, "_na", "_nb", "_i", "_j"), blocks(b, "_nb", "_na", "_j", "_i")
    out = a.join(b.hint("merge"), [*key, "_i", "_j"])
    return out.where(st_distance(F.col(l_col), F.col(r_col)) <= radius).drop(*key, "_i", "_j")
