"""Analysis of a corpus in one pass over the text.

``file_facts`` is a single projection that takes everything from the text that any later
step needs: edges, secret types, AI labels, and the content of the few files whose text is
used again. The result is a narrow table, small next to the text; it is written once and all
tables of the analysis are made from it, so the text is read and matched exactly once.
"""
from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths, vocab
from ..functions.lookups import contains_any
from ..operators import graphs, inventory, relations, scoring, secrets, tech
from ..sources.artifacts import write_artifacts
from ..sources.scratch import saved, scratch_dir


class Analysis(NamedTuple):
    files: DataFrame
    inventory: DataFrame
    important: DataFrame
    relationships: DataFrame
    tech: DataFrame
    findings: DataFrame
    secrets_report: DataFrame


def _content_is_reused(path: Column, score: Column) -> Column:
    """Manifests, setup files, and files that may be important (their text feeds prompts and entities)."""
    name = paths.name(path)
    manifest = name.isin([n for names in vocab.MANIFESTS.values() for n in names])
    setup = path.isin("README.md", "readme.md") | F.contains(F.lower(name), F.lit("dockerfile"))
    models = contains_any(F.lower(path), graphs.MODEL_PATHS)
    return manifest | setup | models | (score >= vocab.MIN_IMPORTANT_SCORE)


def _scored(df: DataFrame, path: str, score: str) -> DataFrame:
    """The rows with the score that the column ``path`` has as a path."""
    own = [c for c in df.columns if c != "path"]
    named = df.select(*own, F.col("path").alias("_own_path"), F.col(path).alias("path"))
    return scoring.score_files(named).select(*own, F.col("_own_path").alias("path"), F.col("score").alias(score))


def file_facts(files: DataFrame, maybe_wrapped: bool = False) -> DataFrame:
    """(repo_id, path, size, content, edges, secret_types, ai_labels) per file. Narrow: no exchange.

    Whether one folder wraps a whole repository shows in its paths only. So with ``maybe_wrapped`` a file gets whatever it
    needs with or without its first folder, and ``unwrapped`` settles which, on the facts instead of the text.
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("content").cast("bigint")
    df = files.select("repo_id", "path", "content", size.alias("size"))
    places = [(F.col("path"), F.col("_score"))]
    df = _scored(df, "path", "_score")
    if maybe_wrapped:
        inner = F.when(F.contains("path", F.lit("/")), F.substring(F.col("path"), F.locate("/", F.col("path")) + 1, F.length("path"))).otherwise(F.col("path"))
        df = _scored(df.withColumn("_inner", inner), "_inner", "_inner_score")
        places.append((F.col("_inner"), F.col("_inner_score")))
    reused = reduce(or_, (_content_is_reused(*p) for p in places))
    # Files in dependency and build folders are not matched at all.
    related = reduce(or_, (inventory.outside("relations", path=p) for p, _ in places))
    swept = reduce(or_, (inventory.outside("sources", path=p) for p, _ in places))
    is_source = paths.extension(F.col("path")).isin(vocab.SOURCE_EXTENSIONS)
    return df.select(
        "repo_id", "path", "size", F.when(reused, F.col("content")).alias("content"),
        F.when(is_source & related, relations.edge_array()).alias("edges"),
        secrets.secret_types(F.col("content")).alias("secret_types"),
        F.when(is_source & swept, tech.ai_labels(F.col("content"))).alias("ai_labels"))


def unwrapped(facts: DataFrame) -> DataFrame:
    """Facts of files that may be wrapped, with the wrapping folders off and without what only the other path needed."""
    own = _scored(inventory.strip_repo_root(facts), "path", "_score")
    return own.select(
        "repo_id", "path", "size", F.when(_content_is_reused(F.col("path"), F.col("_score")), F.col("content")).alias("content"),
        F.when(inventory.outside("relations"), F.col("edges")).alias("edges"), "secret_types",
        F.when(inventory.outside("sources"), F.col("ai_labels")).alias("ai_labels"))


def write_facts(spark: SparkSession, files: DataFrame, path: str | None = None, strip_root: bool = False) -> DataFrame:
    """Writes the facts as Parquet, below ``spark.checkpoint.dir`` unless a path is given, and reads them back.

    A written table survives lost executors, which a cached one does not. ``strip_root`` takes wrapping folders off: the text is
    read once and written facts are joined with the folders.
    """
    path = path or scratch_dir(spark, "facts")
    facts = file_facts(files, maybe_wrapped=strip_root)
    if strip_root:
        facts = unwrapped(saved(facts, "wrapped-facts"))
    facts.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def analyse(facts: DataFrame) -> Analysis:
    """All analysis tables, from facts or directly from files."""
    inv = inventory.inventory(facts)
    edges = relations.relationships(facts)
    findings = secrets.scan_secrets(facts)
    return Analysis(
        files=facts, inventory=inv,
        important=scoring.important_files(inventory.inventory(facts, ["content"]), keep=["content"]),
        relationships=edges, tech=tech.with_external_apis(tech.tech_stack(facts), relations.external_apis(edges)),
        findings=findings, secrets_report=secrets.secrets_report(findings, facts))


TABLES = ("important", "relationships", "tech", "findings", "secrets_report")


def saved_analysis(spark: SparkSession, files: DataFrame, tables: tuple = TABLES, path: str | None = None,
                   strip_root: bool = True) -> Analysis:
    """The analysis with its facts and the named tables written once and read back.

    ``strip_root`` takes off a top folder that wraps a whole repository, as uploads have it.

    Later steps use the stack, the important files and the edges many times; from written
    tables each use is a scan of a small table instead of the analysis all over again.
    """
    path = path or scratch_dir(spark, "analysis")
    result = analyse(write_facts(spark, files, f"{path}/facts", strip_root))
    saved = {}
    for name in tables:
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
        saved[name] = spark.read.parquet(f"{path}/{name}")
    return result._replace(**saved)


def run_analysis(spark: SparkSession, files: DataFrame, directory: str, strip_root: bool = True) -> Analysis:
    """Analyses repositories and replaces their artifacts below ``directory``; those of other repositories stay.

    ``secrets_report`` is the short report; all findings and high-risk files are artifacts of their own.
    """
    result = saved_analysis(spark, files, strip_root=strip_root)
    write_artifacts({
        "tech": result.tech,
        "important_files": result.important.drop("content"),
        "relationships": result.relationships.select("repo_id", "source", "relationship", "target", "evidence"),
        "secrets_report": result.secrets_report,
        "secret_findings": result.findings,
        "high_risk_files": secrets.high_risk_files(result.findings),
    }, directory, repositories=result.files.select("repo_id"))
    return result
