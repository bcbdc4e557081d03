"""Structured Streaming: analysis on arrival, current rows by key, changes of edges as files come again.

The narrow operators (inventory, edges, secret scan) run unchanged on a streaming frame. What a batch writes is published last, under the
number of the batch; a batch that is replayed after that changes nothing.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import paths, vocab
from ..operators import inventory, relations, secrets
from ..plans.analysis import file_facts
from ..sources.archives import archive_rows, bad_archives, files_of, unpack_archives
from ..sources.published import Published, bucket_of, buckets_of, expire, folder_values, publish
from ..sources.scratch import saved, scratch_dir

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"
MEMBERS = "archive string, repo_id string, path string, bytes binary, error string"


def stream_table(spark: SparkSession, path: str, max_files_per_batch: int | None = None) -> DataFrame:
    """Parquet files landing in a folder; the schema is that of what is already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.parquet(path)


def arriving_archives(spark: SparkSession, directory: str) -> DataFrame:
    """ZIP archives landing in a folder, as they are; ``run_archives`` unpacks them."""
    return archive_rows(spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.zip").load(directory))


def stream_members(spark: SparkSession, directory: str) -> DataFrame:
    """Members and errors of ZIP archives landing in a folder; pass them to ``files_of`` or ``bad_archives``."""
    return unpack_archives(arriving_archives(spark, directory))


def stream_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Files of ZIP archives landing in a folder. What could not be read is in ``stream_bad_archives``."""
    return files_of(stream_members(spark, directory))


def stream_bad_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Archives and members landing in a folder that could not be read."""
    return bad_archives(stream_members(spark, directory))


def stream_inventory(files: DataFrame) -> DataFrame:
    """Inventory rows on arrival; stateless, append mode."""
    return inventory.inventory(files)


def stream_edges(files: DataFrame) -> DataFrame:
    """Edges on arrival, deduplicated within each file; stateless, append mode."""
    return relations.relationships(files)


def stream_secrets(files: DataFrame) -> DataFrame:
    """Secret findings on arrival; stateless, append mode."""
    return secrets.scan_secrets(files)


def stream_relationships(files: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """First edge per (repo, source, relationship, target) within ``delay`` of event time.

    A file delivered again within the delay adds nothing; after it, its edges may come again.
    Rows older than the watermark are dropped. State is one entry per edge of the last ``delay``.
    """
    edges = relations.relationships(files.withWatermark(event_time, delay))
    return edges.dropDuplicatesWithinWatermark(["repo_id", "source", "relationship", "target"])


def stream_latest_status(log: DataFrame) -> DataFrame:
    """Current status per project, update mode. State is one row per project."""
    return log.groupBy("project_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("last")) \
        .select("project_id", "last.status", "last.ts", "last.event_id")


def run_append(df: DataFrame, path: str) -> DataFrame:
    """Runs an append stream over everything that has arrived into Parquet below ``path``, and reads it back."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data") \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def run_current(rows: DataFrame, keys: list[str], order: list[str], path: str, buckets: int = 64) -> DataFrame:
    """The last row of every key by ``order`` of everything that has arrived, kept below ``path`` and read back.

    A batch rewrites the buckets that its keys are in, merged with what was there, and publishes them under its number. So reading
    costs the same after any number of batches, rows may come late or again, and a replayed batch does nothing.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        old = Published(spark, path)
        if old.version is not None and old.version >= batch_id:
            return
        new = saved(batch.select(*keys, *rest), "batch")
        n, run = old.buckets or buckets, f"batch-{batch_id}-{uuid.uuid4().hex}"
        touched = buckets_of(new, keys, n)
        there = old.paths("rows", touched)
        both = new.unionByName(spark.read.schema(new.schema).parquet(*there)) if there else new
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")
        last.withColumn("bucket", bucket_of(keys, n)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows/{run}")
        publish(spark, old, n, {"rows": touched}, run, batch_id)
        expire(spark, path, keep=2)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    there = Published(spark, path).paths("rows")
    return spark.read.schema(rows.schema).parquet(*there).select(rows.columns) if there else spark.createDataFrame([], rows.schema)


def run_latest_status(log: DataFrame, path: str) -> DataFrame:
    """Runs the status log over everything that has arrived; returns the current status per project."""
    return run_current(log.select("project_id", "status", "ts", "event_id"), ["project_id"], ["ts", "event_id"], path)


class Arrivals(NamedTuple):
    files: DataFrame
    errors: DataFrame
    facts: DataFrame


def run_archives(archives: DataFrame, path: str) -> Arrivals:
    """Unpacks the archives (archive, repo_id, content) that have arrived, each batch once, and returns what all batches gave.

    A batch writes the members of its archives; its files and its errors are read from these, and the facts of the analysis are made from
    them in one pass over the text. Edges, findings and inventory come from the facts (``analysis.analyse``).
    """
    spark = archives.sparkSession
    folder = lambda table, b: f"{path}/{table}/batch={b}"

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id in folder_values(spark, f"{path}/committed", "batch"):
            return
        unpack_archives(batch).write.mode("overwrite").parquet(folder("members", batch_id))
        file_facts(files_of(spark.read.schema(MEMBERS).parquet(folder("members", batch_id)))).write.mode("overwrite").parquet(folder("facts", batch_id))
        spark.createDataFrame([(batch_id,)], "batch_id bigint").coalesce(1).write.mode("overwrite").parquet(folder("committed", batch_id))

    archives.select("archive", "repo_id", "content").writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = sorted(folder_values(spark, f"{path}/committed", "batch"))
    empty = spark.createDataFrame([], MEMBERS)
    members = spark.read.schema(MEMBERS).parquet(*(folder("members", b) for b in done)) if done else empty
    facts = file_facts(files_of(empty))
    if done:
        facts = spark.read.schema(facts.schema).parquet(*(folder("facts", b) for b in done))
    return Arrivals(files_of(members), bad_archives(members), facts)


# --- changes of edges -----------------------------------------------------------------------------------

_CHANGE = "repo_id string, source string, relationship string, target string, evidence string, sign int"
_LAST = "version bigint, digest string, edges string"


def _changes(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the newest version of one file takes away from and adds to the edges of the version before."""
    newest = max((v for rows in arrived for v in zip(rows["version"], rows["digest"], rows["edges"])), default=None, key=lambda v: v[:2])
    version, digest, edges = state.get if state.exists else (-(1 << 62), "", "[]")
    if newest is None or newest[:2] <= (version, digest):
        return  # late, or the same again
    state.update((int(newest[0]), newest[1], newest[2]))
    if newest[1] == digest:
        return
    as_set = lambda text: {(e["relationship"], e["target"], e["evidence"]) for e in json.loads(text)}
    before, after = as_set(edges), as_set(newest[2])
    rows = [(*key, *e, -1) for e in sorted(before - after)] + [(*key, *e, 1) for e in sorted(after - before)]
    if rows:
        yield pd.DataFrame(rows, columns=["repo_id", "source", "relationship", "target", "evidence", "sign"])


def stream_edge_changes(files: DataFrame, event_time: str) -> DataFrame:
    """Edges added (sign 1) and taken back (-1) as versions of files arrive, append mode.

    A file may come again with the same text, with another one, or late: only its newest version by event time counts (by digest where
    two have the same time). State is one entry per (repository, path): time, digest and edges of its newest version.
    """
    source = paths.extension(F.col("path")).isin(vocab.SOURCE_EXTENSIONS) & inventory.outside("relations")
    found = files.select("repo_id", "path", F.unix_micros(event_time).alias("version"), F.md5("content").alias("digest"),
                         F.when(source, F.sort_array(relations.edge_array())).alias("edges"))
    first = F.transform(relations.first_per_target(F.col("edges")), lambda e: F.struct(
        e.relationship.alias("relationship"), e.target.alias("target"), e.evidence.alias("evidence")))
    narrow = found.select("repo_id", "path", "version", F.coalesce("digest", F.lit("")).alias("digest"),
                          F.coalesce(F.to_json(first), F.lit("[]")).alias("edges"))
    return narrow.groupBy("repo_id", "path").applyInPandasWithState(_changes, _CHANGE, _LAST, "append", GroupStateTimeout.NoTimeout)


def current_edges(changes: DataFrame) -> DataFrame:
    """The edges that all changes together leave."""
    keys = ["repo_id", "source", "relationship", "target", "evidence"]
    return changes.groupBy(*keys).agg(F.sum("sign").alias("sign")).filter("sign > 0").select(*keys)


def fresh_run(spark: SparkSession, name: str) -> str:
    """A folder for one stream run, on the cluster's shared storage."""
    return scratch_dir(spark, f"stream-{name}")
