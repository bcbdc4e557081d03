"""The base table of files from any existing table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table, in the splits of its files; spread over ``partitions`` only where the caller says so,
    as for a small table of one row group, which would be analysed by one task.
    """
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def files_from_table(df: DataFrame, repo: str = "repo_id", path: str = "path", content: str = "content") -> DataFrame:
    """(repo_id, path, content, size in bytes). Unused columns are pruned from the scan."""
    return df.select(F.col(repo).alias("repo_id"), F.col(path).alias("path"), F.col(content).alias("content"),
                     F.octet_length(content).cast("bigint").alias("size"))
