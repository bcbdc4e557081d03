"""Tables of buckets that runs replace in part and publish at once.

    directory/<table>/<run>/bucket=<b>/...       rows of the keys of a bucket, written by a run
    directory/published/version=<n>/*.json       which run has the rows of each table and bucket

A run writes new folders for the buckets that its keys are in, with what stays of the old rows, and then publishes the next version. Until
then, and if it fails, readers see the version before; of two runs that publish the same version the second one fails.
"""
from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import remove

_ENTRY = "kind string, bucket int, run string"


def folder_values(spark: SparkSession, path: str, name: str) -> set[int]:
    """The values of a partition folder ``name=<number>`` below ``path`` that have files."""
    try:
        found = spark.read.schema("x string").text(path).inputFiles()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return set()
    return {int(m[1]) for f in found if (m := re.search(rf"/{name}=(\d+)/[^/]*$", f))}


def versions(spark: SparkSession, directory: str) -> list[int]:
    return sorted(folder_values(spark, f"{directory}/published", "version"))


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class Published:
    """A version of a directory, the newest by default: its buckets, and for each (kind, bucket) the run that has the rows."""

    def __init__(self, spark: SparkSession, directory: str, version: int | None = None):
        self.directory = directory
        self.version = max(versions(spark, directory), default=None) if version is None else version
        self.runs: dict[tuple[str, int], str] = {}
        self.buckets = 0
        if self.version is not None:
            for r in spark.read.schema(_ENTRY).json(f"{directory}/published/version={self.version}").collect():  # kinds x buckets
                if r["kind"] is None:
                    self.buckets = r["bucket"]
                else:
                    self.runs[r["kind"], r["bucket"]] = r["run"]

    def paths(self, kind: str, buckets: set[int] | None = None) -> list[str]:
        return [f"{self.directory}/{k}/{run}/bucket={b}" for (k, b), run in sorted(self.runs.items())
                if k == kind and (buckets is None or b in buckets)]


def buckets_of(keys: DataFrame, names: list[str], n: int) -> set[int]:
    return {r["b"] for r in keys.select(bucket_of(names, n).alias("b")).distinct().collect()}


def publish(spark: SparkSession, old: Published, n: int, touched: dict[str, set[int]], run: str, version: int) -> None:
    """The next version: for the touched buckets of each kind what ``run`` wrote, for all others what ``old`` has.

    The entry without a kind keeps the number of buckets.
    """
    entries = {(k, b): r for (k, b), r in old.runs.items() if b not in touched.get(k, ())}
    for kind in touched:
        entries |= {(kind, b): run for b in folder_values(spark, f"{old.directory}/{kind}/{run}", "bucket")}
    listed = [(None, n, None), *((k, b, r) for (k, b), r in sorted(entries.items()))]
    spark.createDataFrame(listed, _ENTRY).coalesce(1).write.mode("error").json(f"{old.directory}/published/version={version}")


def expire(spark: SparkSession, directory: str, keep: int = 2) -> None:
    """Deletes versions but the newest ``keep``, and the folders that only those named. Not to be called while a run writes."""
    found = versions(spark, directory)
    kept, gone = found[-keep:], found[:-keep]
    of = lambda vs: {(k, b, r) for v in vs for (k, b), r in Published(spark, directory, v).runs.items()}
    for kind, b, run in sorted(of(gone) - of(kept)):
        remove(spark, f"{directory}/{kind}/{run}/bucket={b}")
    for v in gone:
        remove(spark, f"{directory}/published/version={v}")
