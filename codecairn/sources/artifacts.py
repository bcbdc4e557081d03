"""Analysis artifacts as JSON, replaced by repository and published by run (see ``published``).

A repository belongs to the bucket of its hash. A run replaces everything its repositories had; the rows that other repositories
have in the same buckets are carried over.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocab
from .published import Published, bucket_of, buckets_of, expire, publish
from .scratch import saved

SCHEMAS = {
    "tech": "repo_id string, " + ", ".join(f"{f} array<string>" for f in [*vocab.FACETS, "external_apis_detected"]) + ", docker boolean",
    "important_files": "repo_id string, rank int, path string, reason_important string, score int, language string, category string",
    "relationships": "repo_id string, source string, relationship string, target string, evidence string",
    "secrets_report": "repo_id string, total_files_scanned bigint, files_with_secrets bigint, secret_types_found array<string>, "
                      "high_risk_count bigint, findings array<struct<file:string,secret_types:array<string>>>",
    "secret_findings": "repo_id string, file string, secret_types array<string>",
    "high_risk_files": "repo_id string, file string",
    "plan": "repo_id string, major_modules array<struct<name:string,description:string,files:array<string>>>, "
            "explanation_order array<struct<step:int,component:string,reason:string>>, main_user_flow_target string, "
            "required_diagrams array<string>, concepts_needing_analogies array<string>, uncertain_areas array<string>",
    "validation_report": "repo_id string, run_id string, unresolved_file_paths array<struct<section:string,path:string>>, "
                         "unresolved_diagram_components array<struct<diagram:string,component:string>>, "
                         "leaked_secrets_detected array<struct<file:string,secret_types:array<string>>>",
}
#: Buckets of a new directory; a directory keeps the number it began with.
BUCKETS = 64


def _check(kind: str) -> None:
    if kind not in SCHEMAS:
        raise ValueError(f"artifact must be one of: {', '.join(sorted(SCHEMAS))}")


def write_artifacts(frames: dict[str, DataFrame], directory: str, repositories: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replaces what the repositories of a run have in the given kinds, and returns the version published.

    ``repositories`` names those that were analysed, with or without results; those that a frame names count in any case. The
    rebalance hint lets the adaptive planner split a bucket that one repository makes too large for a task.
    """
    for kind in frames:
        _check(kind)
    spark = next(iter(frames.values())).sparkSession
    old = Published(spark, directory)
    n, run, version = old.buckets or buckets, f"run-{uuid.uuid4().hex}", (old.version or 0) + 1
    everyone, *more = [df.select("repo_id") for df in [*frames.values(), *([repositories] if repositories is not None else [])]]
    for df in more:
        everyone = everyone.unionAll(df)
    mine = saved(everyone.distinct(), "repositories")
    touched = buckets_of(mine, ["repo_id"], n)
    for kind, df in frames.items():
        rows, there = df, old.paths(kind, touched)
        if there:
            kept = spark.read.schema(SCHEMAS[kind]).json(there).join(mine, "repo_id", "left_anti")
            rows = rows.unionByName(kept, allowMissingColumns=True)
        rows.withColumn("bucket", bucket_of(["repo_id"], n)).hint("rebalance", "bucket").write.partitionBy("bucket").json(f"{directory}/{kind}/{run}")
    publish(spark, old, n, {kind: touched for kind in frames}, run, version)
    return version


def read_artifact(spark: SparkSession, directory: str, kind: str, version: int | None = None) -> DataFrame:
    """An artifact as last published (or of an older version still there), or an empty frame of its schema."""
    _check(kind)
    paths = Published(spark, directory, version).paths(kind)
    return spark.read.schema(SCHEMAS[kind]).json(paths) if paths else spark.createDataFrame([], SCHEMAS[kind])


def expire_artifacts(spark: SparkSession, directory: str, keep: int = 2) -> None:
    """Deletes what only versions older than the newest ``keep`` have. Not to be called while a run writes."""
    expire(spark, directory, keep)
