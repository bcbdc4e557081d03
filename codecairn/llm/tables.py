"""What the operators share: reading a table and mapping texts in Arrow batches."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark sends a task Arrow batches of about so many bytes, unless the session says otherwise. A task looks at 1000 rows at once, so
#: Spark's own 64 MB would only lie in the executor and in the worker without being looked at.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def batches(rows: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size``, so that a task holds few texts at once."""
    for b in rows:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def map_rows(df: DataFrame, columns: list[str], schema: T.StructType,
             task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over these columns only, so that the scan is pruned and other columns cannot clash.

    Sets ``BATCH_SETTING`` in the session where it is not set yet; it changes no result.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.select(*columns).mapInArrow(lambda rows: task(batches(rows)), schema)


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of ``df`` by name, nullable, to be passed through as they are."""
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def typed(schema: str) -> list[T.StructField]:
    return T.StructType.fromDDL(schema).fields
