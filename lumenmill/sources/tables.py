"""Table sources: Parquet directories as DataFrames and temp views, with typed event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_SHARED: dict[tuple[int, str], set[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one table; columns and filters are pruned by the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    """Expose tables as temp views for SQL text."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_any(spark: SparkSession, fmt: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Any file format that Spark reads: parquet, orc, csv, json, text, binaryFile."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_any(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """Any file format that Spark writes, optionally partitioned by columns."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
