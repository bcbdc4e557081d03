"""Files from a directory tree, one sub-directory per repository.

A tree has many small files. So tasks list the repositories and read the files, and neither names nor sizes pass through the driver
but the names of the repositories. What pyarrow cannot open is left to the ``binaryFile`` source, which lists on the driver.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators.inventory import skip_dirs
from .archives import address
from .scratch import saved

#: About so many bytes, or so many files, are read by one task.
TASK_BYTES, TASK_FILES = 64 << 20, 4000
# Contents are handed over once they have so many bytes together.
_FLUSH_BYTES = 16 << 20
_LISTED = "repo string, inside string, length bigint"


def _shown(name: str) -> bool:
    """Whether Spark's file sources see a file or folder of this name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _walk(store, folder: str) -> Iterator[tuple[str, int]]:
    """(path below the folder, length) of every file that is not empty, one folder in memory at a time."""
    from pyarrow import fs
    below = [""]
    while below:
        at = below.pop()
        for f in store.get_file_info(fs.FileSelector(f"{folder}/{at}".rstrip("/"))):
            if not _shown(f.base_name):
                continue
            if f.type == fs.FileType.Directory:
                below.append(f"{at}{f.base_name}/")
            elif f.type == fs.FileType.File and f.size:
                yield f"{at}{f.base_name}", f.size


def _listing(uri: str):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for repo in batch["repo"]:
                rows = []
                for inside, length in _walk(store, f"{root.rstrip('/')}/{repo}"):
                    rows.append((repo, inside, length))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["repo", "inside", "length"])
                        rows = []
                yield pd.DataFrame(rows, columns=["repo", "inside", "length"])
    return task


def _content(uri: str, path: Column) -> Column:
    """The bytes of the files at paths below the root; a null path is not opened."""
    def task(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows, held = [], 0
            for p in batch:
                data = None
                if p is not None:
                    with store.open_input_file(f"{root.rstrip('/')}/{p}") as f:
                        data = f.read()
                    held += len(data)
                rows.append(data)
                if held > _FLUSH_BYTES:
                    yield pd.Series(rows, dtype=object)
                    rows, held = [], 0
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(task, "binary")(path)


def _by_tasks(spark: SparkSession, uri: str, max_bytes: int | None) -> DataFrame | None:
    """(inside, length, content) of the files below ``uri``; None where pyarrow does not know the store."""
    from pyarrow import ArrowException, fs
    try:
        store, root = fs.FileSystem.from_uri(uri)
    except (ArrowException, OSError):
        return None
    repos = [(f.base_name,) for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and _shown(f.base_name)]
    cores = spark.sparkContext.defaultParallelism
    named = spark.createDataFrame(repos, "repo string").repartition(min(4 * cores, len(repos)) or 1)
    listed = saved(named.mapInPandas(_listing(uri), _LISTED), "tree")
    n, total = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(min(n, 2 * cores), n // TASK_FILES, total // TASK_BYTES, 1)
    inside = F.concat("repo", F.lit("/"), "inside")
    files = listed.repartition(int(tasks), "repo", "inside").select(inside.alias("inside"), "length")
    opened = F.col("inside") if max_bytes is None else F.when(F.col("length") <= max_bytes, F.col("inside"))
    return files.select("inside", "length", _content(uri, opened).alias("content"))


def _by_source(spark: SparkSession, root: str, base: str, max_bytes: int | None) -> DataFrame:
    """The same from the ``binaryFile`` source."""
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    if max_bytes is not None:
        large = binary.filter(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
        binary = binary.filter(F.col("length") <= max_bytes).unionByName(large)
    # Paths come qualified and start with the qualified root, whatever folders inside are called.
    return binary.select(F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path")).alias("inside"), "length", "content")


def read_tree(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """(repo_id, path, content, size) of every file below ``root/<repository>/``; hidden and empty files are none, as for Spark.

    Files above ``max_bytes`` have a row without content and are never opened. Nothing is read at all for a query that only
    needs paths and sizes. The files are listed when this is called.
    """
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(root)
    whole = folder.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(folder)
    binary = _by_tasks(spark, address(whole.toUri().toASCIIString().rstrip("/")), max_bytes)
    if binary is None:
        binary = _by_source(spark, root, whole.toString().rstrip("/") + "/", max_bytes)
    inside = F.col("inside")
    split = binary.select(
        F.substring_index(inside, "/", 1).alias("repo_id"),
        F.when(F.contains(inside, F.lit("/")), F.substring(inside, F.locate("/", inside) + 1, F.length(inside))).alias("path"),
        text.decode_text(F.col("content")).alias("content"), F.col("length").alias("size"))
    return skip_dirs(split.filter("path is not null"))
