from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codecairn import fixtures  # noqa: E402
from codecairn.functions import paths, vocab  # noqa: E402
from codecairn.operators import (graphs, inventory as inv_ops, prompts, relations, results, scoring, secrets, status,  # noqa: E402
                                 tech, validate)
from codecairn.plans import analysis, explanation  # noqa: E402
from codecairn.sources import archives, artifacts, tables, tree  # noqa: E402
from codecairn.sources.scratch import saved, scratch_dir  # noqa: E402
from codecairn.streaming import streams  # noqa: E402

try:  # the training-data operators can be removed as a whole
    import corpus_pipeline
    from codecairn.llm import queries as llm
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "codecairn.llm"):
        raise
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]


def _joined(col: str) -> Column:
    """A list column as text, since list columns compare differently across engines."""
    return F.array_join(col, "|").alias(col)


def _long(*cols: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def _inventory(spark: SparkSession, d: str, keep=None) -> DataFrame:
    return inv_ops.inventory(fixtures.files(spark, d), keep)


# --- paths and inventory -----------------------------------------------------------------

def q_files_from_table(spark, d):
    docs = fixtures.files(spark, d).withColumnsRenamed({"repo_id": "r", "path": "p", "content": "c"})
    return tables.files_from_table(docs, repo="r", path="p", content="c")


def q_path_parts(spark, d):
    df = inv_ops.path_parts(fixtures.files(spark, d))
    return df.select("repo_id", "path", "name", "stem", "extension", _joined("dirs"), *_long("depth"), "top_dir")


def _q_skip_dirs(purpose: str) -> Query:
    return lambda spark, d: inv_ops.skip_dirs(fixtures.files(spark, d), purpose).select("repo_id", "path")


def q_source_files(spark, d):
    return inv_ops.source_files(fixtures.files(spark, d)).select("repo_id", "path", F.octet_length("content").cast("bigint").alias("size"))


def q_strip_repo_root(spark, d):
    return inv_ops.strip_repo_root(fixtures.files(spark, d))


def q_safe_paths(spark, d):
    n = F.length("path") % 7
    prefix = F.when(n == 0, "../").when(n == 1, "a/../").when(n == 2, ".//").when(n == 3, "/") \
        .when(n == 4, "a/../../b/").when(n == 5, "w\\").otherwise("")
    given = fixtures.files(spark, d).select("repo_id", F.concat(prefix, "path").alias("given"))
    return inv_ops.safe_paths(given.withColumn("path", F.col("given"))).select("repo_id", "path", "given")


def q_directory_summary(spark, d):
    df = inv_ops.directory_summary(_inventory(spark, d))
    return df.select("repo_id", *_long("rank"), "top_dir", F.col("files").cast("bigint").alias("n_files"), _joined("languages"))


def q_important_files(spark, d):
    best = scoring.important_files(_inventory(spark, d))
    return best.select("repo_id", *_long("rank"), "path", "reason_important", *_long("score"), "language", "category")


# --- relations --------------------------------------------------------------------------------

def _q_edges(operator) -> Query:
    return lambda spark, d: operator(fixtures.files(spark, d)).select(
        "repo_id", "source", "relationship", "target", "evidence", *_long("line", "pos"))


def _relationships(spark, d):
    return relations.relationships(fixtures.files(spark, d))


def q_relationships(spark, d):
    return _relationships(spark, d).select("repo_id", "source", "relationship", "target", "evidence",
                                           *_long("extractor", "line", "pos"))


def q_dedupe_relationships(spark, d):
    edges = relations.extract(fixtures.files(spark, d), list(relations.EXTRACTORS))
    return relations.dedupe_relationships(edges).select("repo_id", "source", "relationship", "target", "evidence")


def q_evidence(spark, d):
    return _relationships(spark, d).select("repo_id", "source", "evidence").distinct()


def _q_relationships_of(kind: str, n: int) -> Query:
    return lambda spark, d: relations.relationships_of(_relationships(spark, d), kind, n).select(
        "repo_id", *_long("rank"), "source", "target", "evidence")


def _external_apis(spark, d):
    return relations.external_apis(_relationships(spark, d)).select("repo_id", "target")


# --- technology -------------------------------------------------------------------------------------

def _manifests(spark, d, *kinds):
    return tech.find_manifests(fixtures.files(spark, d), list(kinds) or None)


def q_find_manifest(spark, d):
    return _manifests(spark, d).select("repo_id", "kind", "path", F.md5("content").alias("digest"))


def q_npm_dependencies(spark, d):
    return tech.npm_dependencies(_manifests(spark, d, "npm")).select("repo_id", *_long("ord"), "dep", "version")


def q_pip_dependencies(spark, d):
    return tech.pip_dependencies(_manifests(spark, d, "pip")).select("repo_id", *_long("ord"), "dep")


def q_pyproject_dependencies(spark, d):
    return tech.pyproject_dependencies(_manifests(spark, d, "pyproject")).select("repo_id", *_long("ord"), "dep")


def q_maven_labels(spark, d):
    return tech.maven_labels(_manifests(spark, d, "maven")).select("repo_id", "facet", "label", *_long("pos"))


def q_gradle_labels(spark, d):
    return tech.gradle_labels(_manifests(spark, d, "gradle")).select("repo_id", "facet", "label", *_long("pos"))


def q_container_facts(spark, d):
    return tech.container_facts(_manifests(spark, d)).select("repo_id", "docker", _joined("images"), _joined("databases"))


def q_match_dependencies(spark, d):
    deps = tech.npm_dependencies(_manifests(spark, d, "npm"))
    return tech.match_dependency_facets(deps).select("repo_id", "facet", "label", *_long("ord"))


def q_ai_source_hits(spark, d):
    return tech.ai_source_hits(fixtures.files(spark, d)).select("repo_id", "label", *_long("pos"))


def q_package_managers(spark, d):
    return tech.package_managers(fixtures.files(spark, d)).select("repo_id", "label", *_long("pos"))


def q_tech_facts(spark, d):
    return tech.tech_facts(fixtures.files(spark, d)).select("repo_id", "facet", "label", *_long("src", "pos"))


def _stack(spark, d):
    files = fixtures.files(spark, d)
    return tech.with_external_apis(tech.tech_stack(files), relations.external_apis(relations.relationships(files)))


def q_tech_stack(spark, d):
    return _stack(spark, d).select("repo_id", *[_joined(f) for f in [*vocab.FACETS, "external_apis_detected"]], "docker")


def q_tech_summary(spark, d):
    return tech.tech_summary(_stack(spark, d)).select("repo_id", "facet", _joined("labels"))


# --- secrets -----------------------------------------------------------------------------------------

def q_scan_secrets(spark, d):
    return secrets.scan_secrets(fixtures.files(spark, d)).select("repo_id", "file", _joined("secret_types"))


def q_mask_secrets(spark, d):
    return secrets.mask_secrets(fixtures.files(spark, d), "content").select(
        "repo_id", "path", F.md5("masked").alias("masked_digest"), _joined("secret_types"))


def _secrets_report(spark, d):
    files = fixtures.files(spark, d)
    return secrets.secrets_report(secrets.scan_secrets(files), files)


def q_secrets_report(spark, d):
    entry_text = F.transform("findings", lambda x: F.concat_ws(":", x.file, F.array_join(x.secret_types, "+")))
    return _secrets_report(spark, d).select("repo_id", *_long("total_files_scanned", "files_with_secrets"),
                                            _joined("secret_types_found"), *_long("high_risk_count"),
                                            F.array_join(entry_text, "|").alias("findings"))


# --- status -------------------------------------------------------------------------------------------

def q_latest_status(spark, d):
    return status.latest_status(fixtures.status_log(spark, d)).select("project_id", "status", "event_id")


def q_status_view(spark, d):
    latest = status.latest_status(fixtures.status_log(spark, d))
    return status.status_view(latest).select("project_id", "status", "stage", *_long("progress"), "is_complete", "is_error",
                                             "can_generate", "results_ready")


# --- sources and sinks ------------------------------------------------------------------------------

def _archives(spark, d):
    """(archive, repo_id, content) rows: ZIP archives packed from batches of the derived files."""
    import io
    import zipfile

    def pack(batches):  # texts stay in the batch until they are packed
        import pyarrow as pa
        for b in batches:
            rows, (paths_, contents) = {}, (b.column("path"), b.column("content"))
            for k, repo in enumerate(b.column("repo_id").to_pylist()):
                if repo is not None:
                    rows.setdefault(repo, []).append(k)
            for repo in sorted(rows):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for k in rows[repo]:
                        z.writestr("./" + paths_[k].as_py(), contents[k].as_py())
                data = buffer.getvalue()
                yield pa.RecordBatch.from_pydict({"archive": [f"{repo}.zip", f"cut-{repo}.zip"], "repo_id": [repo, f"cut-{repo}"],
                                                  "content": pa.array([data, data[:len(data) // 2]], pa.binary())})
            del b, paths_, contents

    files = fixtures.files(spark, d)
    return files.mapInArrow(pack, "archive string, repo_id string, content binary")


def q_read_archives(spark, d):
    members = archives.unpack_archives(_archives(spark, d))
    return archives.files_of(members).select("repo_id", "path", "content", "size")


def q_bad_archives(spark, d):
    members = archives.unpack_archives(_archives(spark, d))
    return archives.bad_archives(members).select("archive", "repo_id", F.substring_index("error", ":", 1).alias("error")).distinct()


def _damaged(spark, d, folder=None):
    """(archive, repo_id, content): archives of up to a sixteenth of a repository, the data of their first wanted member damaged.
    With a folder, they are files there, and the rows have no content."""
    import io
    import zipfile

    import pandas as pd

    skipped = set(vocab.SKIP_DIRS["inventory"])

    def pack(key, rows):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(rows["path"], rows["content"])):
                z.writestr(path, content)
            first = next((i for i in z.infolist() if not skipped & set(i.filename.split("/"))), None)
        data = bytearray(buffer.getvalue())
        if first is not None:
            at = first.header_offset + 30 + len(first.filename)
            data[at:at + first.compress_size] = bytes(0xFF ^ x for x in data[at:at + first.compress_size])
        name = f"{key[0]}~{key[1]}"
        if folder is not None:
            from pyarrow import fs
            store, root = fs.FileSystem.from_uri(archives.address(folder))
            store.create_dir(root)
            with store.open_output_stream(f"{root}/{name}.zip") as out:
                out.write(data)
        return pd.DataFrame({"archive": [f"{name}.zip"], "repo_id": [name], "content": [None if folder is not None else bytes(data)]})

    parts = fixtures.files(spark, d).withColumn("part", F.length("path") % 16)
    return parts.groupBy("repo_id", "part").applyInPandas(pack, "archive string, repo_id string, content binary")


def q_damaged_members(spark, d):
    members = archives.unpack_archives(_damaged(spark, d))
    return archives.bad_archives(members).select("archive", "repo_id", "path")


def _by_range(spark, d):
    """The same archives as files, read by the ranges of their members; ranges of 4 KB, so that an archive is in many."""
    folder = scratch_dir(spark, "zips")
    _damaged(spark, d, folder).agg(F.count("archive")).collect()
    return archives.read_archives_by_range(spark, f"{folder}/*.zip", range_bytes=4096)


def q_read_archives_by_range(spark, d):
    files = archives.files_of(_by_range(spark, d))
    return files.select(F.substring_index("repo_id", "~", 1).alias("repo_id"), "path", "content", "size")


def q_bad_members_by_range(spark, d):
    return archives.bad_archives(_by_range(spark, d)).select("repo_id", "path")


def _planted(files, root):
    """Writes (repo_id, path, content) rows as ``root/repo_id=<repository>/path=<path>/all.txt``: the rows of a path one after the
    other, each with a \\x01 at its end. Names as Spark has them for partitions, but without its renaming of every file at the end."""
    def put(batches):
        import pandas as pd
        from pyarrow import fs
        store, top = fs.FileSystem.from_uri(archives.address(root))
        escaped = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
        named = lambda v: escaped.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__"
        last, out = None, None
        for b in batches:
            for repo, path, content in zip(b["repo_id"], b["path"], b["content"]):
                if (key := (named(repo), named(path))) != last:
                    if out is not None:
                        out.close()
                    folder, last = f"{top}/repo_id={key[0]}/path={key[1]}", key
                    store.create_dir(folder)
                    out = store.open_output_stream(f"{folder}/all.txt")
                out.write(f"{content or ''}\x01".encode())
            yield pd.DataFrame({"n": [len(b)]})
        if out is not None:
            out.close()

    dealt = files.repartition("repo_id", "path").sortWithinPartitions("repo_id", "path")
    dealt.mapInPandas(put, "n int").agg(F.sum("n")).collect()


def q_read_tree(spark, d):
    """Every file by its digest."""
    root = scratch_dir(spark, "tree")
    _planted(fixtures.files(spark, d).select("repo_id", "path", F.concat("path", F.lit("\n"), "content").alias("content")), root)
    read = tree.read_tree(spark, root).filter(F.endswith("path", F.lit(".txt")))
    folder = F.url_decode(F.regexp_extract("path", r"^path=([^/]*)/", 1))
    whole = F.rtrim("content", F.lit("\x01"))
    return read.select(F.regexp_replace("repo_id", "^repo_id=", "").alias("repo_id"), folder.alias("path"), (F.col("size") - 1).alias("size"),
                       F.md5(whole).alias("digest"))


def q_decode_text(spark, d):
    from codecairn.functions import text
    raw = F.concat(F.encode("content", "UTF-8"), F.unhex(F.lit("FF41")))
    decoded = text.decode_text(raw)
    return fixtures.files(spark, d).select("repo_id", "path", F.length(decoded).cast("bigint").alias("n_chars"),
                                           F.right(decoded, F.lit(2)).alias("tail"))


def q_artifacts(spark, d):
    out = scratch_dir(spark, "artifacts")
    artifacts.write_artifacts({"important_files": scoring.important_files(_inventory(spark, d))}, out)
    return artifacts.read_artifact(spark, out, "important_files").select("repo_id", *_long("rank"), "path", "reason_important",
                                                                         *_long("score"), "language", "category")


def _artifact_rows(spark, out):
    """Every row of the six analysis artifacts as (repo_id, kind, item, digest of the rest)."""
    lists = lambda *names: [F.array_join(n, "|") for n in names]
    found = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x.file, F.array_join(x.secret_types, "+"))), "|")
    text = {
        "tech": (F.lit(""), [*lists(*vocab.FACETS, "external_apis_detected"), F.col("docker").cast("string")]),
        "important_files": (F.col("path"), ["rank", "score", "reason_important", "language", "category"]),
        "relationships": (F.concat_ws(" ", "source", "relationship", "target"), ["evidence"]),
        "secrets_report": (F.lit(""), ["total_files_scanned", "files_with_secrets", F.array_join("secret_types_found", "|"), "high_risk_count", found]),
        "secret_findings": (F.col("file"), lists("secret_types")),
        "high_risk_files": (F.col("file"), [F.lit("")]),
    }
    rows = None
    for kind, (item, rest) in text.items():
        df = artifacts.read_artifact(spark, out, kind).select(
            "repo_id", F.lit(kind).alias("kind"), item.alias("item"), F.md5(F.concat_ws("#", *rest)).alias("digest"))
        rows = df if rows is None else rows.unionByName(df)
    return rows


def q_run_analysis(spark, d):
    """All artifacts from one pass over the text, read back."""
    out = scratch_dir(spark, "analysis")
    analysis.run_analysis(spark, fixtures.files(spark, d), out, strip_root=False)
    return _artifact_rows(spark, out)


#: A third of the repositories, by their name's digest: those that come again.
_SECOND = "md5(repo_id) < '5'"


def q_artifacts_replaced(spark, d):
    """All repositories are analysed; a third of them once more, with half of their files. The others stay as they were."""
    out = scratch_dir(spark, "artifacts")
    files = fixtures.files(spark, d)
    again = files.filter(f"{_SECOND} AND length(path) % 2 = 0")
    for part, repositories in ((files, None), (again, files.filter(_SECOND).select("repo_id"))):
        artifacts.write_artifacts({"important_files": scoring.important_files(inv_ops.inventory(part)),
                                   "secret_findings": secrets.scan_secrets(part)}, out, repositories)
    artifacts.expire_artifacts(spark, out, keep=1)
    best = artifacts.read_artifact(spark, out, "important_files").select("repo_id", F.lit("important_files").alias("kind"), "path", *_long("rank"))
    found = artifacts.read_artifact(spark, out, "secret_findings").select(
        "repo_id", F.lit("secret_findings").alias("kind"), F.col("file").alias("path"), F.lit(None).cast("bigint").alias("rank"))
    return best.unionByName(found)


def q_secret_findings(spark, d):
    """All findings as an artifact, of which the report shows the first."""
    out = scratch_dir(spark, "findings")
    artifacts.write_artifacts({"secret_findings": secrets.scan_secrets(fixtures.files(spark, d))}, out)
    return artifacts.read_artifact(spark, out, "secret_findings").select("repo_id", "file", _joined("secret_types"))


# --- graphs -----------------------------------------------------------------------------------------

_NODE = ["repo_id", "diagram", "node_id", "label", "shape"]
_EDGE = ["repo_id", "diagram", "source", "target", "arrow", "label"]


def _important_with_content(spark, d):
    return scoring.important_files(_inventory(spark, d, ["content"]), keep=["content"])


def _flows(spark, d):
    """One document per generation run: its at most nine sections, in order."""
    per_run = fixtures.sections(spark, d).groupBy("repo_id", "run_id").agg(
        F.array_sort(F.collect_list(F.struct("section", "markdown"))).alias("s"))
    return per_run.select("repo_id", "run_id", F.array_join("s.markdown", "\n").alias("markdown"))


def _graph(which: str):
    return {"architecture": lambda s, d: graphs.architecture_graph(_stack(s, d)),
            "repository_map": lambda s, d: graphs.repository_map(_inventory(s, d)),
            "entity": lambda s, d: graphs.entity_graph(_important_with_content(s, d)),
            "user_flow": lambda s, d: graphs.user_flow(_flows(s, d))}[which]


def _q_nodes(which: str, *extra: str) -> Query:
    return lambda s, d: _graph(which)(s, d)[0].select(*extra, *_NODE, *_long("pos"))


def _q_edges_of(which: str, *extra: str) -> Query:
    return lambda s, d: _graph(which)(s, d)[1].select(*extra, *_EDGE, *_long("pos"))


def q_flow_steps(spark, d):
    return graphs.flow_steps(_flows(spark, d)).select("repo_id", "run_id", *_long("step_no"), "num", "action", "file", "participant")


def _analysis(spark, d, tables=("important", "relationships", "tech")):
    """The analysis tables, made in one pass over the text and saved for the steps that follow."""
    return analysis.saved_analysis(spark, fixtures.files(spark, d), tables, strip_root=False)


def q_analysis_of_wrapped_repo(spark, d):
    """Uploads with one folder around everything: the analysis takes it off first."""
    wrapped = fixtures.files(spark, d).withColumn("path", F.concat(F.lit("upload/"), "path"))
    best = analysis.saved_analysis(spark, wrapped, ("important",)).important
    return best.select("repo_id", *_long("rank"), "path", "reason_important", *_long("score"), "language", "category")


def q_diagram_text(spark, d):
    return explanation.repository_diagrams(_analysis(spark, d))


def q_flow_text(spark, d):
    return graphs.diagram_text(*graphs.user_flow(_flows(spark, d)), keys=["repo_id", "run_id"])


# --- validation ---------------------------------------------------------------------------------------

def q_path_mentions(spark, d):
    return validate.path_mentions(fixtures.sections(spark, d))


def q_unresolved_paths(spark, d):
    return validate.unresolved_paths(validate.path_mentions(fixtures.sections(spark, d)), _inventory(spark, d))


def _drawn(spark, d, a):
    """All four diagrams of every run, written once."""
    runs = fixtures.sections(spark, d).select("repo_id", "run_id").distinct()
    return saved(explanation.drawn(a, runs, q_flow_text(spark, d)), "diagrams")


def q_diagram_labels(spark, d):
    return validate.diagram_labels(_drawn(spark, d, _analysis(spark, d)))


def q_unresolved_components(spark, d):
    a = _analysis(spark, d)
    labels = validate.diagram_labels(_drawn(spark, d, a))
    return validate.unresolved_components(labels, validate.known_components(a.important, a.relationships))


def _report(spark, d, a):
    return explanation.checked(a, fixtures.sections(spark, d), _drawn(spark, d, a))


def _flat_report(prefix=""):
    """The three lists of a report as texts."""
    def flat(name, a, b):
        return F.array_join(F.transform(prefix + name, lambda x: F.concat_ws(":", x[a], x[b])), "|").alias(name)

    leaks = F.array_join(F.transform(prefix + "leaked_secrets_detected", lambda x: F.concat_ws(":", x.file, F.array_join(x.secret_types, "+"))), "|")
    return [flat("unresolved_file_paths", "section", "path"), flat("unresolved_diagram_components", "diagram", "component"),
            leaks.alias("leaked_secrets_detected")]


def q_validation_report(spark, d):
    return _report(spark, d, _analysis(spark, d)).select("repo_id", "run_id", *_flat_report())


def q_saved_validation_report(spark, d):
    """The reports of all runs as an artifact, and then those of a third of the repositories without their unresolved paths."""
    out = scratch_dir(spark, "reports")
    report = saved(_report(spark, d, _analysis(spark, d)), "report")
    artifacts.write_artifacts({"validation_report": report}, out)
    second = report.filter(_SECOND).withColumn("unresolved_file_paths", F.array().cast(report.schema["unresolved_file_paths"].dataType))
    artifacts.write_artifacts({"validation_report": second}, out)
    return artifacts.read_artifact(spark, out, "validation_report").select("repo_id", "run_id", *_flat_report())


def q_masked_sections(spark, d):
    return validate.masked_sections(fixtures.sections(spark, d)).select("repo_id", "run_id", "section", F.md5("markdown").alias("digest"))


def q_evidence_labels(spark, d):
    df = validate.evidence_labels(fixtures.sections(spark, d))
    return df.select("repo_id", "run_id", "section", *_long(*df.columns[3:]))


# --- prompts -----------------------------------------------------------------------------------------------

def q_truncate_text(spark, d):
    from codecairn.functions import text
    return fixtures.files(spark, d).select(
        "repo_id", "path", F.md5(text.truncate_text(F.col("content"))).alias("digest"),
        F.md5(text.truncate_text(F.col("content"), vocab.FILE_CHARS, vocab.FILE_NOTE)).alias("file_digest"),
        text.estimate_tokens(F.col("content")).alias("tokens"))


def q_file_prompts(spark, d):
    return prompts.file_prompts(_important_with_content(spark, d)).select("repo_id", *_long("rank"), "path", "prompt")


def _summaries(important):
    """Summaries from the answers a model might give for the important files."""
    return prompts.parse_model_json(important.withColumn("answer", F.expr(fixtures.ANSWER_SQL)))


def q_parse_model_json(spark, d):
    return _summaries(scoring.important_files(_inventory(spark, d))).select("repo_id", "path", "responsibility", _joined("important_symbols"), "inputs", "outputs",
                                       _joined("connections"), "evidence_snippet")


def q_compact_summaries(spark, d):
    df = prompts.compact_summaries(_summaries(scoring.important_files(_inventory(spark, d))))
    return df.select("repo_id", F.array_join("plan_lines", "\n").alias("plan_text"), F.array_join("section_lines", "\n\n").alias("section_text"))


def _edge_texts(spark, d):
    return prompts.compact_relationships(_relationships(spark, d))


def q_compact_relationships(spark, d):
    names = ["all_lines", "declares_route_lines", "imports_lines", "calls_api_lines", "plan_routes"]
    return _edge_texts(spark, d).select("repo_id", *[F.array_join(n, "\n").alias(n) for n in names], *_long("n_routes"))


def _tech_texts(spark, d):
    return prompts.compact_tech(_stack(spark, d))


def q_plan_prompts(spark, d):
    a = _analysis(spark, d)
    df = prompts.plan_prompts(fixtures.projects(spark, d), prompts.compact_tech(a.tech), prompts.compact_summaries(_summaries(a.important)),
                              prompts.compact_relationships(a.relationships))
    return df.select("repo_id", "prompt")


def _plans(spark, d):
    return prompts.parse_plan(fixtures.projects(spark, d).select("repo_id", F.expr(fixtures.PLAN_ANSWER_SQL).alias("answer")))


def _flat_plans(plans):
    return plans.select("repo_id", F.to_json("major_modules").alias("major_modules"),
                        F.to_json("explanation_order").alias("explanation_order"), "main_user_flow_target",
                        _joined("required_diagrams"), _joined("concepts_needing_analogies"), _joined("uncertain_areas"))


def q_parse_plan(spark, d):
    return _flat_plans(_plans(spark, d))


def q_saved_plan(spark, d):
    """Plans as an artifact, read back."""
    out = scratch_dir(spark, "plans")
    artifacts.write_artifacts({"plan": _plans(spark, d).drop("answer")}, out)
    return _flat_plans(artifacts.read_artifact(spark, out, "plan"))


def q_setup_files(spark, d):
    return prompts.setup_files(fixtures.files(spark, d)).select(
        "repo_id", "readme", "package_json", "requirements", F.array_join("dockerfiles", "\n\n").alias("dockerfiles"))


def q_section_prompts(spark, d):
    a = _analysis(spark, d, analysis.TABLES)
    context = explanation.context_of(a, fixtures.projects(spark, d), _summaries(a.important), _plans(spark, d))
    return prompts.section_prompts(context).select("repo_id", "section", "prompt")


def q_apply_text_model(spark, d):
    def model(system_prompt: str, prompt: str) -> str:
        if len(prompt) % 4 == 0:
            raise ValueError("no answer")
        return prompt.split("\n", 1)[0].upper()

    rows = prompts.apply_text_model(prompts.file_prompts(_important_with_content(spark, d)), model)
    return rows.select("repo_id", *_long("rank"), "path", "answer", "error")


# --- results -----------------------------------------------------------------------------------------------

def q_results_payload(spark, d):
    a, sections = _analysis(spark, d), fixtures.sections(spark, d)
    diagrams, masked = _drawn(spark, d, a), saved(validate.masked_sections(sections), "masked-sections")
    payload = results.results_payload(masked, diagrams, tech.tech_summary(a.tech), explanation.checked(a, sections, diagrams, masked))

    def flat(col):
        return F.md5(F.array_join(F.transform(F.map_entries(col), lambda e: F.concat_ws("=", e.key, e.value)), "|")).alias(col)

    lists = F.transform(F.map_entries("tech_summary"), lambda e: F.concat_ws("=", e.key, F.array_join(e.value, ",")))
    return payload.select("repo_id", "run_id", flat("sections"), flat("diagrams"), F.array_join(lists, "|").alias("tech_summary"),
                          *_flat_report("validation_report."))


def q_output_index(spark, d):
    """Plans are saved for a third of the repositories."""
    out = scratch_dir(spark, "plans")
    artifacts.write_artifacts({"plan": _plans(spark, d).filter(_SECOND).drop("answer")}, out)
    df = results.output_index(fixtures.sections(spark, d), artifacts.read_artifact(spark, out, "plan"))
    names = F.transform("sections", lambda x: F.concat_ws(":", x["name"], x["size_bytes"].cast("string")))
    return df.select("repo_id", "run_id", *_long("sections_ready", "sections_expected"), F.array_join(names, "|").alias("sections"), "plan_ready")


# --- streams -------------------------------------------------------------------------------------------------

def _landed(spark, df, name):
    """A table landing in six files, taken two at a time: three batches."""
    folder = scratch_dir(spark, name)
    df.repartition(6).write.parquet(folder)
    return streams.stream_table(spark, folder, max_files_per_batch=2)


def _stream_files(spark, d):
    return fixtures.files(spark, d, _landed(spark, tables.read_table(spark, f"{d}/documents.parquet"), "documents"))


def q_stream_inventory(spark, d):
    return streams.run_append(streams.stream_inventory(_stream_files(spark, d)), streams.fresh_run(spark, "inventory"))


def q_stream_edges(spark, d):
    out = streams.run_append(streams.stream_edges(_stream_files(spark, d)), streams.fresh_run(spark, "edges"))
    return out.select("repo_id", "source", "relationship", "target", "evidence")


def q_stream_secrets(spark, d):
    out = streams.run_append(streams.stream_secrets(_stream_files(spark, d)), streams.fresh_run(spark, "secrets"))
    return out.select("repo_id", "file", _joined("secret_types"))


def _at(files, hour):
    return files.withColumn("arrived", F.to_timestamp(F.lit(f"2024-01-01 {hour}:00")))


def q_stream_relationships(spark, d):
    """Three deliveries. The second repeats the first third within the delay and moves the watermark on by two hours with the second
    third; of the last, the third third is too late, and the first third, forgotten by then, comes once more."""
    files = saved(fixtures.files(spark, d), "files")
    part = lambda k: files.filter(F.length("path") % 3 == k)
    deliveries = [_at(part(0), "10:00"), _at(part(0), "10:01").unionByName(_at(part(1), "12:30")),
                  _at(part(2), "10:30").unionByName(_at(part(0), "12:40"))]
    landing, run = scratch_dir(spark, "landing"), streams.fresh_run(spark, "relationships")
    for files in deliveries:
        files.write.mode("append").parquet(landing)
        out = streams.run_append(streams.stream_relationships(streams.stream_table(spark, landing), "arrived"), run)
    return out.groupBy("repo_id", "source", "relationship", "target", "evidence").agg(F.count(F.lit(1)).alias("times"))


def q_stream_latest_status(spark, d):
    log = fixtures.status_log(spark, d, _landed(spark, tables.read_table(spark, f"{d}/events.parquet"), "events"))
    return streams.run_latest_status(log, streams.fresh_run(spark, "status")).select("project_id", "status", "event_id")


def _versions(spark, d):
    """Three deliveries of files: all; a third changed and a third as before; a third late and a third replaced."""
    files = saved(fixtures.files(spark, d), "files")
    part = lambda k: files.filter(F.length("path") % 3 == k)
    text = lambda df, c: df.withColumn("content", c)
    return [_at(files, "01:00"),
            _at(text(part(0), F.concat("content", F.lit("\nimport changed\nfetch('/api/changed')"))), "03:00").unionByName(_at(part(1), "03:00")),
            _at(text(part(0), F.lit("import late")), "02:00").unionByName(_at(text(part(2), F.lit("import fresh\nfetch('/api/fresh')")), "04:00"))]


def q_stream_current_edges(spark, d):
    """Files that come again, changed or late: the edges of their newest versions."""
    landing, run = scratch_dir(spark, "landing"), streams.fresh_run(spark, "changes")
    for files in _versions(spark, d):
        files.write.mode("append").parquet(landing)
        changes = streams.run_append(streams.stream_edge_changes(streams.stream_table(spark, landing), "arrived"), run)
    return streams.current_edges(changes)


def q_stream_current_inventory(spark, d):
    """The inventory of the newest version of every path."""
    landing, run = scratch_dir(spark, "landing"), streams.fresh_run(spark, "current")
    for files in _versions(spark, d):
        files.write.mode("append").parquet(landing)
        rows = inv_ops.inventory(streams.stream_table(spark, landing), keep=["arrived"])
        current = streams.run_current(rows, ["repo_id", "path"], ["arrived"], run)
    return current.drop("arrived")


def _arrivals(spark, d):
    """Archives, whole and cut ones, arriving in three parts."""
    landing, run = scratch_dir(spark, "landing"), streams.fresh_run(spark, "archives")
    packed = saved(_archives(spark, d), "archives")
    for k in range(3):
        packed.filter(F.crc32("archive") % 3 == k).write.mode("append").parquet(landing)
        arrivals = streams.run_archives(streams.stream_table(spark, landing), run)
    return arrivals


def q_stream_files(spark, d):
    return _arrivals(spark, d).files.select("repo_id", "path", "content", "size")


def q_stream_bad_archives(spark, d):
    return _arrivals(spark, d).errors.select("archive", "repo_id", F.substring_index("error", ":", 1).alias("error")).distinct()


def q_stream_facts(spark, d):
    """Edges of the files in arriving archives, from the facts of their batches."""
    edges = relations.relationships(_arrivals(spark, d).facts)
    return edges.select("repo_id", "source", "relationship", "target", "evidence")


def entry(spark: SparkSession) -> DataFrame:
    """The most important files of every repository."""
    return q_important_files(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        "files_from_table": q_files_from_table,
        "path_parts": q_path_parts,
        **{f"skip_dirs_{p}": _q_skip_dirs(p) for p in vocab.SKIP_DIRS},
        "source_files": q_source_files,
        "strip_repo_root": q_strip_repo_root,
        "safe_paths": q_safe_paths,
        "with_language": lambda s, d: inv_ops.with_language(fixtures.files(s, d)).select("repo_id", "path", "language"),
        "with_category": lambda s, d: inv_ops.with_category(fixtures.files(s, d)).select("repo_id", "path", "category"),
        "inventory": lambda s, d: _inventory(s, d),
        "directory_summary": q_directory_summary,
        "file_counts": lambda s, d: inv_ops.file_counts(_inventory(s, d)).withColumnRenamed("files", "n_files"),
        "score_files": lambda s, d: scoring.score_files(_inventory(s, d)).select("repo_id", "path", *_long("score"), "reason_important"),
        "important_files": q_important_files,
        "js_imports": _q_edges(relations.js_imports),
        "js_dynamic_imports": _q_edges(relations.js_dynamic_imports),
        "js_http_calls": _q_edges(relations.js_http_calls),
        "js_routes": _q_edges(relations.js_routes),
        "py_imports": _q_edges(relations.py_imports),
        "py_requests_calls": _q_edges(relations.py_requests_calls),
        "py_httpx_calls": _q_edges(relations.py_httpx_calls),
        "py_decorator_routes": _q_edges(relations.py_decorator_routes),
        "flask_routes": _q_edges(relations.flask_routes),
        "django_urls": _q_edges(relations.django_urls),
        "orm_usage": _q_edges(relations.orm_usage),
        "dedupe_relationships": q_dedupe_relationships,
        "relationships": q_relationships,
        "evidence": q_evidence,
        **{f"relationships_of_{k}": _q_relationships_of(k, n) for k, n in
           (("imports", 30), ("declares_route", 30), ("calls_api", 20), ("uses_model", 20))},
        "external_apis": _external_apis,
        "find_manifest": q_find_manifest,
        "npm_dependencies": q_npm_dependencies,
        "pip_dependencies": q_pip_dependencies,
        "pyproject_dependencies": q_pyproject_dependencies,
        "maven_labels": q_maven_labels,
        "gradle_labels": q_gradle_labels,
        "container_facts": q_container_facts,
        "match_dependencies": q_match_dependencies,
        "ai_source_hits": q_ai_source_hits,
        "languages_by_extension": lambda s, d: tech.languages_by_extension(fixtures.files(s, d)),
        "package_managers": q_package_managers,
        "tech_facts": q_tech_facts,
        "tech_stack": q_tech_stack,
        "tech_summary": q_tech_summary,
        "scan_secrets": q_scan_secrets,
        "mask_secrets": q_mask_secrets,
        "secrets_report": q_secrets_report,
        "high_risk_files": lambda s, d: secrets.high_risk_files(secrets.scan_secrets(fixtures.files(s, d))),
        "latest_status": q_latest_status,
        "status_view": q_status_view,
        "read_archives": q_read_archives,
        "bad_archives": q_bad_archives,
        "damaged_members": q_damaged_members,
        "read_archives_by_range": q_read_archives_by_range,
        "bad_members_by_range": q_bad_members_by_range,
        "read_tree": q_read_tree,
        "decode_text": q_decode_text,
        "artifacts": q_artifacts,
        "run_analysis": q_run_analysis,
        "artifacts_replaced": q_artifacts_replaced,
        "saved_plan": q_saved_plan,
        "saved_validation_report": q_saved_validation_report,
        "analysis_of_wrapped_repo": q_analysis_of_wrapped_repo,
        "secret_findings": q_secret_findings,
        "results_payload": q_results_payload,
        "output_index": q_output_index,
        "output_section": lambda s, d: results.output_section(fixtures.sections(s, d), "sections/06_main_user_flow"),
        "architecture_nodes": _q_nodes("architecture"),
        "architecture_edges": _q_edges_of("architecture"),
        "flow_steps": q_flow_steps,
        "user_flow_nodes": _q_nodes("user_flow", "run_id"),
        "user_flow_edges": _q_edges_of("user_flow", "run_id"),
        "repository_map_nodes": _q_nodes("repository_map"),
        "repository_map_edges": _q_edges_of("repository_map"),
        "entity_nodes": _q_nodes("entity"),
        "entity_edges": _q_edges_of("entity"),
        "diagram_text": q_diagram_text,
        "flow_text": q_flow_text,
        "path_mentions": q_path_mentions,
        "unresolved_paths": q_unresolved_paths,
        "diagram_labels": q_diagram_labels,
        "unresolved_components": q_unresolved_components,
        "masked_sections": q_masked_sections,
        "validation_report": q_validation_report,
        "evidence_labels": q_evidence_labels,
        "truncate_text": q_truncate_text,
        "file_prompts": q_file_prompts,
        "parse_model_json": q_parse_model_json,
        "compact_summaries": q_compact_summaries,
        "compact_relationships": q_compact_relationships,
        "compact_tech": lambda s, d: _tech_texts(s, d),
        "plan_prompts": q_plan_prompts,
        "parse_plan": q_parse_plan,
        "level_style": lambda s, d: prompts.level_style(fixtures.projects(s, d)),
        "setup_files": q_setup_files,
        "section_prompts": q_section_prompts,
        "apply_text_model": q_apply_text_model,
        "stream_inventory": q_stream_inventory,
        "stream_edges": q_stream_edges,
        "stream_secrets": q_stream_secrets,
        "stream_latest_status": q_stream_latest_status,
        "stream_relationships": q_stream_relationships,
        "stream_current_edges": q_stream_current_edges,
        "stream_current_inventory": q_stream_current_inventory,
        "stream_files": q_stream_files,
        "stream_bad_archives": q_stream_bad_archives,
        "stream_facts": q_stream_facts,
        **(llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    import oracle
    extra = dict(llm.ORACLE_SQL) if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: oracle.compose(sql, oracle.TABLES.get(name, {})) for name, sql in oracle.QUERIES.items()} | extra
