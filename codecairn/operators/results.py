"""Assembled results per generation run."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab


def _text_map(key: str, value: str) -> Column:
    """Map of a bounded group: nine section names or four diagram names."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))


def results_payload(sections: DataFrame, diagrams: DataFrame, summary: DataFrame, report: DataFrame) -> DataFrame:
    """One row per run: maps of sections, diagrams and the non-empty stack facets, and the validation report.

    ``sections``, ``diagrams`` and ``report`` are keyed by (repo_id, run_id), ``summary``
    (the output of ``tech_summary``) by repo_id.
    """
    keys = ["repo_id", "run_id"]
    per_run = sections.groupBy(*keys).agg(_text_map("section", "markdown").alias("sections"))
    drawn = diagrams.groupBy(*keys).agg(_text_map("diagram", "text").alias("diagrams"))
    stack = summary.groupBy("repo_id").agg(_text_map("facet", "labels").alias("tech_summary"))
    checks = report.select(*keys, F.struct("unresolved_file_paths", "unresolved_diagram_components",
                                           "leaked_secrets_detected").alias("validation_report"))
    texts = F.expr("cast(map() as map<string,string>)")
    lists = F.expr("cast(map() as map<string,array<string>>)")
    return per_run.join(drawn, keys, "full").join(checks, keys, "left").join(stack, "repo_id", "left").select(
        *keys, F.coalesce("sections", texts).alias("sections"), F.coalesce("diagrams", texts).alias("diagrams"),
        F.coalesce("tech_summary", lists).alias("tech_summary"), "validation_report")


def output_index(sections: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Per run: sections ready and expected, name and size of every section in order, and whether its repository has a plan.

    ``plans``: the saved plans (artifact ``plan``); without them no plan is ready.
    """
    entry = F.struct(F.col("section").alias("name"), F.concat("section", F.lit(".md")).alias("filename"),
                     F.octet_length("markdown").alias("size_bytes"))
    index = sections.groupBy("repo_id", "run_id").agg(
        F.count(F.lit(1)).alias("sections_ready"), F.array_sort(F.collect_list(entry)).alias("sections")) \
        .withColumn("sections_expected", F.lit(len(vocab.SECTION_NAMES)))
    if plans is None:
        return index.withColumn("plan_ready", F.lit(False))
    ready = plans.select("repo_id").distinct().withColumn("plan_ready", F.lit(True))
    return index.join(ready, "repo_id", "left").fillna(False, ["plan_ready"])


def output_section(sections: DataFrame, section: str) -> DataFrame:
    """The text of one section of every run; only the last part of the given name counts."""
    return sections.filter(F.col("section") == section.replace("\\", "/").rsplit("/", 1)[-1])
