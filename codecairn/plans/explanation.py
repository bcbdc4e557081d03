"""From an analysis to prompts, sections, diagrams and their validation.

The model is a function of the caller. Its answers are written before they are used: a
lost executor must not repeat a call.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graphs, prompts, results, tech, validate
from ..sources.artifacts import write_artifacts
from ..sources.scratch import saved, scratch_dir
from .analysis import Analysis

Model = Callable[[str, str], str]


def answered(spark: SparkSession, rows: DataFrame, model: Model, name: str, partitions: int | None = None) -> DataFrame:
    """Model answers, written once and read back."""
    path = scratch_dir(spark, name)
    prompts.apply_text_model(rows, model, partitions).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def context_of(a: Analysis, projects: DataFrame, summaries: DataFrame, plans: DataFrame) -> DataFrame:
    return prompts.section_context(
        projects, prompts.compact_tech(a.tech), prompts.compact_summaries(summaries), prompts.compact_relationships(a.relationships),
        plans, a.inventory, a.important, prompts.setup_files(a.files), a.secrets_report, prompts.high_risk_text(a.findings))


def repository_diagrams(a: Analysis) -> DataFrame:
    """(repo_id, diagram, text) of the architecture, folder and entity diagrams."""
    pairs = [graphs.architecture_graph(a.tech), graphs.repository_map(a.inventory), graphs.entity_graph(a.important)]
    nodes, edges = pairs[0]
    for n, e in pairs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return graphs.diagram_text(nodes, edges)


def drawn(a: Analysis, runs: DataFrame, flows: DataFrame) -> DataFrame:
    """(repo_id, run_id, diagram, text): the three diagrams of the repository in each of its runs, and the flow of the run."""
    columns = ["repo_id", "run_id", "diagram", "text"]
    repositories = runs.select("repo_id").distinct()
    a = a._replace(**{t: getattr(a, t).join(repositories, "repo_id", "left_semi") for t in ("tech", "inventory", "important")})
    return repository_diagrams(a).join(runs, "repo_id").select(columns).unionByName(flows.select(columns))


def checked(a: Analysis, sections: DataFrame, diagrams: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """The validation report of every run, over all of its diagrams (repo_id, run_id, diagram, text).

    ``masked``: the masked sections, if the caller has them written.
    """
    known = validate.known_components(a.important, a.relationships)
    return validate.validation_report(sections, a.inventory, validate.unresolved_in_diagrams(diagrams, known), masked)


def explain(spark: SparkSession, a: Analysis, projects: DataFrame, model: Model, partitions: int | None = None,
            directory: str | None = None) -> DataFrame:
    """File summaries, plan, nine sections, diagrams and validation: one result row per repository.

    With a ``directory``, plans and validation reports are saved there as artifacts of their repositories.
    """
    files = answered(spark, prompts.file_prompts(a.important), model, "summaries", partitions)
    summaries = prompts.parse_model_json(files)
    plan_rows = prompts.plan_prompts(projects, prompts.compact_tech(a.tech), prompts.compact_summaries(summaries),
                                     prompts.compact_relationships(a.relationships))
    plans = prompts.parse_plan(answered(spark, plan_rows, model, "plans", partitions))
    rows = prompts.section_prompts(context_of(a, projects, summaries, plans))
    sections = prompts.sections_from_answers(answered(spark, rows, model, "sections", partitions)) \
        .withColumn("run_id", F.col("repo_id"))
    flows = graphs.diagram_text(*graphs.user_flow(sections.filter(F.col("section") == "06_main_user_flow")), keys=["repo_id", "run_id"])
    diagrams = saved(drawn(a, sections.select("repo_id", "run_id").distinct(), flows), "diagrams")
    masked = saved(validate.masked_sections(sections), "masked-sections")
    report = saved(checked(a, sections, diagrams, masked), "reports")
    if directory:
        write_artifacts({"plan": plans.select("repo_id", *prompts.PLAN_FIELDS), "validation_report": report}, directory,
                        repositories=projects.select("repo_id"))
    return results.results_payload(masked, diagrams, tech.tech_summary(a.tech), report)
