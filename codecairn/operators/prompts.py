"""Prompt tables for text models, and the tables made from their answers.

A prompt is assembled per repository from small, already capped lists, so every join here
is between tables with one row per repository.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import paths, text, vocab
from ..functions.lookups import array_literal, lookup
from . import secrets as secret_ops
from .inventory import directory_summary, file_counts
from .ranking import top_n

EMPTY_TEXTS = "array<string>"


def _empty() -> Column:
    return F.array().cast(EMPTY_TEXTS)


def _or(col: Column, default: str) -> Column:
    """The text, or ``default`` when it is null or empty."""
    return F.when(F.length(col) > 0, col).otherwise(F.lit(default))


# --- files ------------------------------------------------------------------------------

FILE_SYSTEM_PROMPT = (
    "You analyse one source file of a repository. Answer with a single JSON object with the keys responsibility, "
    "important_symbols (up to 8), inputs, outputs, connections and evidence_snippet (1-3 lines of code).")


def file_prompts(important: DataFrame) -> DataFrame:
    """One prompt per important file: (repo_id, rank, path, system_prompt, prompt).

    ``important`` carries its content, see ``important_files(keep=["content"])``.
    """
    body = text.truncate_text(F.coalesce("content", F.lit("(file could not be read)")), vocab.FILE_CHARS, vocab.FILE_NOTE)
    prompt = F.concat(F.lit("File path   : "), "path", F.lit("\nLanguage    : "), "language", F.lit("\nWhy notable : "),
                      "reason_important", F.lit("\n\n--- FILE CONTENT ---\n"), body, F.lit("\n--- END ---"))
    return important.select("repo_id", "rank", "path", F.lit(FILE_SYSTEM_PROMPT).alias("system_prompt"),
                            text.truncate_text(prompt).alias("prompt"))


_SUMMARY = ("array<struct<responsibility:string,important_symbols:array<string>,inputs:string,outputs:string,"
            "connections:array<string>,evidence_snippet:string>>")


def _one_json(answer: Column, schema: str) -> Column:
    """The struct of a text that is exactly one JSON object, else null."""
    docs = F.from_json(F.concat(F.lit("["), answer, F.lit("]")), schema, {"allowSingleQuotes": "false"})
    return F.when(F.size(docs) == 1, F.get(docs, F.lit(0)))


def parse_model_json(answers: DataFrame, col: str = "answer") -> DataFrame:
    """Adds the six summary fields. Text that is not JSON becomes the responsibility, cut at 500 characters."""
    raw = F.col(col)
    parsed = answers.withColumn("_d", _one_json(raw, _SUMMARY))
    good = F.col("_d").isNotNull()
    fallback = _or(F.substring(text.strip(raw), 1, 500), "Summarisation failed.")

    def field(name: str) -> Column:
        return F.coalesce(F.col(f"_d.{name}"), F.lit("")).alias(name)

    def listed(name: str) -> Column:
        return F.coalesce(F.col(f"_d.{name}"), _empty()).alias(name)

    return parsed.select(
        *answers.columns, F.when(good, F.coalesce("_d.responsibility", F.lit(""))).otherwise(fallback).alias("responsibility"),
        listed("important_symbols"), field("inputs"), field("outputs"), listed("connections"), field("evidence_snippet"))


# --- compact texts ----------------------------------------------------------------------------

def _names(col: str, n: int) -> Column:
    return _or(F.array_join(F.slice(col, 1, n), ", "), "none")


def plan_summary_line() -> Column:
    return F.concat(F.lit("• "), "path", F.lit("\n  Responsibility: "), "responsibility", F.lit("\n  Symbols: "),
                    _names("important_symbols", 5), F.lit(" | Connects to: "), _names("connections", 4))


def section_summary_line() -> Column:
    snippet = F.substring(F.translate("evidence_snippet", "\n", " "), 1, 120)
    return F.concat(F.lit("### "), "path", F.lit("\n**Responsibility**: "), "responsibility", F.lit("\n**Inputs**: "), "inputs",
                    F.lit(" | **Outputs**: "), "outputs", F.lit("\n**Symbols**: "), _names("important_symbols", 6),
                    F.lit(" | **Connects to**: "), _names("connections", 4), F.lit("\n**Snippet**: `"), snippet, F.lit("`"))


def compact_summaries(summaries: DataFrame, max_items: int = 20) -> DataFrame:
    """(repo_id, plan_lines, section_lines): the first summaries of a repository as text lines, in rank order."""
    first = summaries.filter(F.col("rank") <= max_items)
    line = F.struct("rank", plan_summary_line().alias("plan"), section_summary_line().alias("section"))
    return first.groupBy("repo_id").agg(F.array_sort(F.collect_list(line)).alias("l")).select(
        "repo_id", F.col("l.plan").alias("plan_lines"), F.col("l.section").alias("section_lines"))


_LINE_CAPS = {"declares_route": 30, "imports": 30, "calls_api": 20}
_ALL_CAP = 40


def compact_relationships(edges: DataFrame) -> DataFrame:
    """Per repository the first edges as text: all kinds (40), routes (30), imports (30), API calls (20),
    routes for the plan (30), and the number of routes.

    The first 40 of all kinds are among the first 40 of each kind, so one cut per
    (repository, kind) on the map side serves every list.
    """
    order = [paths.parts(F.col("source")), F.col("extractor"), F.col("line"), F.col("pos"), F.col("target")]
    first = top_n(edges, ["repo_id", "relationship"], order, _ALL_CAP, "kind_rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order)))
    line = F.concat(F.lit("• ["), "relationship", F.lit("] "), "source", F.lit(" → "), "target",
                    F.lit("  (evidence: "), F.substring("evidence", 1, 80), F.lit(")"))
    short = F.concat(F.lit("• "), "source", F.lit(": "), "target")

    def lines(keep: Column, rank: str, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(rank).alias("rank"), value.alias("line")))))

    aggs = [lines(F.col("rank") <= _ALL_CAP, "rank", line).alias("all_lines")]
    for kind, cap in _LINE_CAPS.items():
        aggs.append(lines((F.col("relationship") == kind) & (F.col("kind_rank") <= cap), "kind_rank", line).alias(f"{kind}_lines"))
    aggs.append(lines((F.col("relationship") == "declares_route") & (F.col("kind_rank") <= 30), "kind_rank", short).alias("plan_routes"))
    texts = ranked.groupBy("repo_id").agg(*aggs)
    names = ["all_lines", *[f"{k}_lines" for k in _LINE_CAPS], "plan_routes"]
    counts = edges.groupBy("repo_id").agg(F.count_if(F.col("relationship") == "declares_route").alias("n_routes"))
    return texts.select("repo_id", *[F.col(f"{n}.line").alias(n) for n in names]).join(counts, "repo_id")


_TECH_KEYS = [*vocab.FACETS[:7], "docker", *vocab.FACETS[7:], "external_apis_detected"]


def _tech_lines(bullet: str, close: str, cut: int | None) -> Column:
    lines = []
    for k in _TECH_KEYS:
        head = f"{bullet}{k}{close}: "
        if k == "docker":
            lines.append(F.when(F.col(k), F.lit(head + "yes")))
        else:
            values = F.slice(k, 1, cut) if cut else F.col(k)
            lines.append(F.when(F.size(k) > 0, F.concat(F.lit(head), F.array_join(values, ", "))))
    return F.concat_ws("\n", *lines)


def compact_tech(stack: DataFrame) -> DataFrame:
    """(repo_id, tech_text, plan_tech_text): the stack as bullet text, lists cut at 10, and uncut for the plan."""
    return stack.select("repo_id", _or(_tech_lines("- **", "**", 10), "No tech data.").alias("tech_text"),
                        _tech_lines("  ", "", None).alias("plan_tech_text"))


# --- plan ------------------------------------------------------------------------------------------

PLAN_SYSTEM_PROMPT = (
    "You plan the explanation of a software repository for readers who did not write it. Answer with a single JSON object "
    "with the keys major_modules (name, description, files), explanation_order (step, component, reason), "
    "main_user_flow_target, required_diagrams, concepts_needing_analogies and uncertain_areas.")


def plan_prompts(projects: DataFrame, tech_texts: DataFrame, summary_texts: DataFrame, edge_texts: DataFrame) -> DataFrame:
    """One plan prompt per repository: (repo_id, system_prompt, prompt). Missing descriptions leave their part out."""
    df = projects.join(tech_texts, "repo_id", "left").join(summary_texts, "repo_id", "left").join(edge_texts, "repo_id", "left")

    def optional(title: str, col: str) -> Column:
        return F.when(F.length(col) > 0, F.concat(F.lit(f"## {title}\n"), col))

    prompt = F.concat_ws(
        "\n\n",
        optional("Product Description (user-provided)", "product_description"),
        optional("Key Features (user-provided)", "important_features"),
        F.concat(F.lit("## Technology Stack\n"), F.coalesce("plan_tech_text", F.lit(""))),
        F.concat(F.lit("## Important Files (with LLM summaries)\n"), F.coalesce(F.array_join("plan_lines", "\n"), F.lit(""))),
        F.concat(F.lit("## Declared API Routes\n"), _or(F.array_join("plan_routes", "\n"), "No routes detected.")))
    return df.select("repo_id", F.lit(PLAN_SYSTEM_PROMPT).alias("system_prompt"), text.truncate_text(prompt).alias("prompt"))


_PLAN = ("array<struct<major_modules:array<struct<name:string,description:string,files:array<string>>>,"
         "explanation_order:array<struct<step:int,component:string,reason:string>>,main_user_flow_target:string,"
         "required_diagrams:array<string>,concepts_needing_analogies:array<string>,uncertain_areas:array<string>>>")
PLAN_FIELDS = ["major_modules", "explanation_order", "main_user_flow_target", "required_diagrams",
               "concepts_needing_analogies", "uncertain_areas"]


def parse_plan(answers: DataFrame, col: str = "answer", error: str = "the answer is not valid JSON") -> DataFrame:
    """Plan fields of every answer; a minimal plan that names the failure when it is not JSON."""
    parsed = answers.withColumn("_d", _one_json(F.col(col), _PLAN))
    fallback = {
        "main_user_flow_target": F.lit("primary user flow"),
        "required_diagrams": array_literal(["architecture overview", "data flow"]),
        "uncertain_areas": F.array(F.lit(f"Plan generation failed: {error}")),
    }
    out = []
    for f in PLAN_FIELDS:
        field = F.col(f"_d.{f}")
        none = F.lit("primary user journey") if f == "main_user_flow_target" else F.array()
        bad = fallback.get(f, F.array())
        out.append(F.when(F.col("_d").isNotNull(), F.coalesce(field, none.cast(_plan_type(f)))).otherwise(bad.cast(_plan_type(f))).alias(f))
    return parsed.select(*answers.columns, *out)


def _plan_type(field: str) -> str:
    return {"major_modules": "array<struct<name:string,description:string,files:array<string>>>",
            "explanation_order": "array<struct<step:int,component:string,reason:string>>",
            "main_user_flow_target": "string"}.get(field, EMPTY_TEXTS)


# --- levels and setup files ---------------------------------------------------------------------------

def level_style(projects: DataFrame) -> DataFrame:
    """(repo_id, level, style): known level, else beginner, and its style text."""
    level = F.when(F.col("technical_level").isin(list(vocab.LEVELS)), F.col("technical_level")).otherwise(vocab.DEFAULT_LEVEL)
    styles = {}
    for name, c in vocab.LEVELS.items():
        flags = [on if c[flag] else off for flag, (on, off) in vocab.STYLE_LINES.items()]
        styles[name] = "\n".join(["## Audience & Writing Style", f"- **Tone**: {c['tone']}",
                                  f"- **Depth**: {c['max_technical_depth']}", *flags])
    return projects.select("repo_id", level.alias("level"), lookup(level, styles).alias("style"))


_MAX_DOCKERFILES, _DOCKERFILE_CHARS = 5, 800


def setup_files(files: DataFrame) -> DataFrame:
    """(repo_id, readme, package_json, requirements, dockerfiles): capped texts of the setup files.

    Only the few named files reach the shuffle, already cut to their caps.
    """
    name = F.lower(paths.name(F.col("path")))
    is_docker = F.contains(name, F.lit("dockerfile"))
    wanted = files.filter(F.col("path").isin("README.md", "readme.md", "package.json", "requirements.txt") | is_docker)
    capped = wanted.select("repo_id", "path", is_docker.alias("is_docker"), F.when(
        is_docker, text.truncate_text(F.col("content"), _DOCKERFILE_CHARS, vocab.SETUP_NOTE))
        .otherwise(text.truncate_text(F.col("content"), vocab.FILE_CHARS, vocab.SETUP_NOTE)).alias("body")) \
        .filter(F.length("body") > 0)

    def root(path: str) -> Column:
        return F.max(F.when(F.col("path") == path, F.col("body")))

    roots = capped.filter(~F.col("is_docker")).groupBy("repo_id").agg(
        F.coalesce(root("README.md"), root("readme.md")).alias("readme"),
        root("package.json").alias("package_json"), root("requirements.txt").alias("requirements"))
    boxes = top_n(capped.filter("is_docker"), ["repo_id"], [paths.parts(F.col("path"))], _MAX_DOCKERFILES)
    shown = F.concat(F.lit("--- "), "path", F.lit(" ---\n"), "body")
    docker = boxes.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("t")))).alias("d")) \
        .select("repo_id", F.col("d.t").alias("dockerfiles"))
    return roots.join(docker, "repo_id", "full").withColumn("dockerfiles", F.coalesce("dockerfiles", _empty()))


# --- sections --------------------------------------------------------------------------------------------

# Our own wording of the task per section: (title, task).
SECTION_TASKS = {
    "01_start_here": ("Start Here", "In at most 300 words say what the repository does, what the reader will learn and "
                                    "which sections to read first."),
    "02_product_overview": ("Product Overview", "Describe the product, its users, capabilities and data flow. Label every claim "
                                                "[User-Provided], [Repository-Evidence] or [Inferred]."),
    "03_tech_stack": ("Tech Stack", "For each technology explain what it is, why it is used here, where it appears and what it "
                                    "depends on. Write prose and group related technologies."),
    "04_architecture": ("Architecture", "Explain the pattern, the layers, the integration points and notable designs as a "
                                        "narrative that cites files. Say so where details are unclear."),
    "05_component_guide": ("Component Guide", "Describe 5 to 10 components: description, responsibility, input, output, connections, "
                                              "key files and confidence (Confirmed, Inferred, Unclear or Missing)."),
    "06_main_user_flow": ("Main User Flow", "Trace the main user journey. Head each step '**Step N — [Action Name]**' and list "
                                            "'- **What happens**', '- **File**' and '- **Evidence**'. Never invent steps."),
    "07_repo_guide": ("Repo Guide", "Describe each top-level folder (purpose, file types, capability, study order) and list the "
                                    "most important files."),
    "08_how_to_run": ("How to Run", "Give only commands with direct evidence below, from prerequisites to containers. Mark what "
                                    "cannot be confirmed. Name variables, never values."),
    "09_unknowns_and_risks": ("Unknowns & Risks", "List inferred areas, missing documentation, security concerns, risks and open "
                                                  "questions; for each, why it matters and how to investigate."),
}


def section_system_prompt(section: str, style: Column) -> Column:
    title, task = SECTION_TASKS[section]
    return F.concat(F.lit("You write one section of a repository tutorial.\n\n"), style,
                    F.lit(f"\n\n## Your task\n{task}\n\nReturn only Markdown. Start with: # {title}"))


def important_lines(important: DataFrame, n: int = 20) -> DataFrame:
    line = F.concat(F.lit("- `"), "path", F.lit("` — "), "reason_important", F.lit(" (score: "), F.col("score").cast("string"), F.lit(")"))
    return important.filter(F.col("rank") <= n).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("l")) \
        .select("repo_id", F.col("l.t").alias("important_lines"))


def directory_lines(inv: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- **"), "top_dir", F.lit("/**: "), F.col("files").cast("string"), F.lit(" files, langs: "),
                    F.array_join("languages", ", "))
    return directory_summary(inv).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("l")) \
        .select("repo_id", F.col("l.t").alias("dir_lines"))


def high_risk_text(findings: DataFrame, chars: int = vocab.PROMPT_CHARS) -> DataFrame:
    """(repo_id, high_risk_text): high-risk files joined by ", ".

    A prompt is cut at ``chars`` characters. Every entry adds at least three, so the entries
    beyond ``chars / 3`` lie behind the cut and need not be collected.
    """
    first = top_n(secret_ops.high_risk_files(findings), ["repo_id"], [F.col("file")], chars // 3 + 1)
    return first.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("high_risk_text"))


def section_context(projects: DataFrame, tech_texts: DataFrame, summary_texts: DataFrame, edge_texts: DataFrame,
                    plans: DataFrame, inv: DataFrame, important: DataFrame, setup: DataFrame, report: DataFrame,
                    risk_texts: DataFrame) -> DataFrame:
    """Everything the nine prompts of a repository need, on one row; for the repositories in ``projects``."""
    per_repo = [projects.withColumn("_known", F.lit(True)), level_style(projects), tech_texts, summary_texts, edge_texts,
                plans.select("repo_id", *PLAN_FIELDS), directory_lines(inv), important_lines(important),
                file_counts(inv).withColumnRenamed("files", "n_files"), setup, report, risk_texts]
    return side_by_side(per_repo, "repo_id").filter("_known").drop("_known")


def side_by_side(tables: list[DataFrame], key: str) -> DataFrame:
    """One row per key with the columns of all tables, each of which has at most one row per key.

    The tables are stacked, each with its own columns filled, and folded by one aggregation: one exchange instead of a join for each.
    """
    own = [[f for f in df.schema.fields if f.name != key] for df in tables]
    seen: dict[str, str] = {}
    for f in (f for fields in own for f in fields):
        seen.setdefault(f.name, f.dataType)
    stacked = None
    for df in tables:
        rows = df.select(key, *(F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in seen.items()))
        stacked = rows if stacked is None else stacked.unionAll(rows)
    return stacked.groupBy(key).agg(*(F.any_value(n, True).alias(n) for n in seen))


def section_prompts(context: DataFrame) -> DataFrame:
    """Nine rows per repository: (repo_id, section, system_prompt, prompt)."""
    tech = F.coalesce("tech_text", F.lit("No tech data."))

    def summaries(n: int) -> Column:
        return F.coalesce(F.array_join(F.slice("section_lines", 1, n), "\n\n"), F.lit(""))

    def edges(col: str, n: int) -> Column:
        return _or(F.array_join(F.slice(col, 1, n), "\n"), "No relationships detected.")

    def size(col: str, n: int) -> Column:
        return F.coalesce(F.least(F.size(col), F.lit(n)), F.lit(0)).cast("string")

    def given(col: str, title: str, none: str) -> Column:
        return F.concat(F.lit(f"## {title}\n"), _or(F.col(col), none))

    def block(title: str, body: Column) -> Column:
        return F.concat(F.lit(f"## {title}\n"), body)

    def part(*cols: Column) -> Column:
        return F.concat_ws("\n\n", *cols)

    def lines(col: str) -> Column:
        return F.coalesce(F.array_join(col, "\n"), F.lit(""))

    def setup(title: str, col: str, n: int) -> Column:
        return F.when(F.length(col) > 0, block(title, F.substring(col, 1, n)))

    def number(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit(0)).cast("string")

    dockerfiles = F.transform("dockerfiles", lambda d: F.substring(d, 1, _DOCKERFILE_CHARS))
    routes_title = F.concat(F.lit("## Declared Routes ("), number("n_routes"), F.lit(" total)\n"), edges("declares_route_lines", 30))
    imports_title = F.concat(F.lit("## Internal Imports (sample of "), size("imports_lines", 30), F.lit(")\n"), edges("imports_lines", 30))
    apis_title = F.concat(F.lit("## External API Calls ("), size("calls_api_lines", 20), F.lit(" total)\n"), edges("calls_api_lines", 20))
    report = F.concat(
        F.lit("- Files scanned: "), number("total_files_scanned"), F.lit("\n- Files with secrets: "), number("files_with_secrets"),
        F.lit("\n- Secret types found: "), _or(F.array_join("secret_types_found", ", "), "none"),
        F.lit("\n- High-risk files: "), _or(F.col("high_risk_text"), "none"))
    findings = F.coalesce(F.to_json("findings"), F.lit("[]"))
    uncertain = F.when(F.size("uncertain_areas") > 0, F.to_json("uncertain_areas")).otherwise("None flagged.")
    modules = F.coalesce(F.to_json("major_modules"), F.lit("[]"))
    steps = F.coalesce(F.to_json(F.slice("explanation_order", 1, 5)), F.lit("[]"))

    prompts = {
        "01_start_here": part(block("Tech Stack", tech), block("Major Modules", modules),
                              block("Suggested Reading Order (first 5 steps)", steps),
                              block("Main User Flow This Tutorial Will Trace",
                                    F.coalesce("main_user_flow_target", F.lit("primary user journey")))),
        "02_product_overview": part(given("product_description", "User-Provided Product Description", "(none provided)"),
                                    block("Tech Stack (from repository)", tech),
                                    block("Important File Summaries (from repository)", summaries(15))),
        "03_tech_stack": part(block("Detected Tech Stack", tech), block("File Summaries for Context", summaries(10))),
        "04_architecture": part(block("Tech Stack", tech), routes_title, imports_title, apis_title,
                                block("File Summaries", summaries(15))),
        "05_component_guide": part(block("File Summaries", summaries(20)), block("Relationships (sample)", edges("all_lines", 40))),
        "06_main_user_flow": part(given("important_features", "User-Provided Key Features",
                                        "(none provided — infer the main flow from the code)"),
                                  block("API Routes (potential flow entry points)", edges("declares_route_lines", 30)),
                                  block("File Summaries", summaries(15)),
                                  block("Imports / Dependencies", edges("imports_lines", 25))),
        "07_repo_guide": part(block("Top-Level Directory Summary", lines("dir_lines")),
                              block("Heuristically Important Files", lines("important_lines")),
                              F.concat(F.lit("## Total files in inventory: "), number("n_files"))),
        "08_how_to_run": part(F.coalesce(setup("README.md content (first 3000 chars)", "readme", 3000), F.lit("## README.md\n(not found)")),
                              setup("package.json (first 2000 chars)", "package_json", 2000),
                              setup("requirements.txt", "requirements", 1000),
                              F.when(F.size("dockerfiles") > 0,
                                     block("Dockerfile content(s)", F.array_join(dockerfiles, "\n\n---\n\n")))),
        "09_unknowns_and_risks": part(block("Uncertain Areas (from explanation plan)", uncertain), block("Secrets Report", report),
                                      block("Sample Secret Findings", findings), block("Tech Stack (for context)", tech)),
    }
    rows = F.array(*[F.struct(F.lit(s).alias("section"), section_system_prompt(s, F.col("style")).alias("system_prompt"),
                              text.truncate_text(p).alias("prompt")) for s, p in prompts.items()])
    return context.select("repo_id", F.explode(rows).alias("p")).select("repo_id", "p.section", "p.system_prompt", "p.prompt")


# --- model calls --------------------------------------------------------------------------------------------

def apply_text_model(prompts: DataFrame, model: Callable[[str, str], str], partitions: int | None = None) -> DataFrame:
    """Adds ``answer`` and ``error`` by calling ``model(system_prompt, prompt)`` on the tasks.

    A failing call yields a null answer and its message instead of a failed job.
    ``partitions`` bounds how many calls run at once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for system_prompt, prompt in zip(b["system_prompt"], b["prompt"]):
                try:
                    answers.append(model(system_prompt, prompt))
                    errors.append(None)
                except Exception as e:  # any failure of the user's function belongs to its row
                    answers.append(None)
                    errors.append(str(e))
            yield b.assign(answer=pd.Series(answers, index=b.index, dtype=object),
                           error=pd.Series(errors, index=b.index, dtype=object))

    spread = prompts.repartition(partitions) if partitions else prompts
    schema = T.StructType([*spread.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    return spread.mapInPandas(run, schema)


def failed_section(section: Column, error: Column) -> Column:
    """Markdown shown for a section whose model call failed."""
    title = F.initcap(F.translate(section, "_", " "))
    return F.concat(F.lit("# "), title, F.lit("\n\n> ⚠️ This section could not be generated due to an error: "), error, F.lit("\n"))


def sections_from_answers(answers: DataFrame) -> DataFrame:
    """(repo_id, section, markdown) from the output of ``apply_text_model`` on section prompts."""
    return answers.select("repo_id", "section", F.coalesce("answer", failed_section(F.col("section"), F.coalesce("error", F.lit("the model gave no answer")))).alias("markdown"))
