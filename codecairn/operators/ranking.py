"""Top-n rows per group that stays distributed when one group holds most of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per ``keys`` in ``order``, numbered from 1 in ``rank``.

    Spark cuts every map task to n rows per group before the shuffle (WindowGroupLimit) for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, by default 1000; raise it for larger n.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
