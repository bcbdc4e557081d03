"""Checks of generated text and diagrams against the files that really exist."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, text, vocab
from ..sources.scratch import saved
from . import secrets

# Patterns in the subset that Java and RE2 read alike.
PATH_TOKEN = r"\b(?:[a-zA-Z0-9_\-.]+/)*[a-zA-Z0-9_\-.]+\.[a-zA-Z0-9_]{1,10}\b"
DECIMAL = r"^\d+\.\d+$"
BRACKETED = r"""\["[^"]+"\]|\[[^\]]+\]|\([^)]+\)"""
QUOTED_BOX = r"""^\["[^"]+"\]$"""
ACTOR = r"(?:actor|participant)\s+([a-zA-Z0-9_\-.]+)"


def _mention_array(markdown: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(markdown, F.lit(PATH_TOKEN), F.lit(0)))
    return F.filter(found, lambda p: ~(F.startswith(p, F.lit("http")) | F.startswith(p, F.lit("www."))
                                       | F.rlike(p, F.lit(DECIMAL))))


def path_mentions(sections: DataFrame, col: str = "markdown") -> DataFrame:
    """Distinct path-like tokens per section: (repo_id, run_id, section, path). Narrow."""
    return sections.select("repo_id", "run_id", "section", F.explode(_mention_array(F.col(col))).alias("path"))


def unresolved_paths(mentions: DataFrame, inv: DataFrame) -> DataFrame:
    """Mentions that are neither a path nor a base name in their repository.

    Two anti-joins on (repository, path) and (repository, base name): keys fine enough to
    spread one large repository. Inventory keys are distinct first, so a base name repeated
    in every folder is one row.
    """
    keys = mentions.withColumn("_name", paths.name(F.col("path")))
    known_paths = inv.select("repo_id", "path").distinct()
    known_names = inv.select("repo_id", paths.name(F.col("path")).alias("_name")).distinct()
    return keys.join(known_paths, ["repo_id", "path"], "left_anti") \
        .join(known_names, ["repo_id", "_name"], "left_anti") \
        .select("repo_id", "run_id", "section", "path").distinct()


def _label_array(diagram: Column) -> Column:
    boxes = F.transform(F.regexp_extract_all(diagram, F.lit(BRACKETED), F.lit(0)), lambda m: text.strip(
        F.when(F.rlike(m, F.lit(QUOTED_BOX)), F.substring(m, F.lit(3), F.length(m) - 4))
        .otherwise(F.substring(m, F.lit(2), F.length(m) - 2))))
    return F.array_union(boxes, F.regexp_extract_all(diagram, F.lit(ACTOR), F.lit(1)))


def _run(df: DataFrame) -> list[str]:
    return [c for c in ("run_id",) if c in df.columns]


def diagram_labels(diagrams: DataFrame) -> DataFrame:
    """Distinct labels and actor names per diagram: (repo_id, run_id if there is one, diagram, label). Narrow."""
    return diagrams.select("repo_id", *_run(diagrams), "diagram", F.explode(_label_array(F.col("text"))).alias("label"))


def known_components(important: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct lower-case important paths, their base names, and edge sources and targets."""
    names = important.select("repo_id", F.explode(F.array("path", paths.name(F.col("path")))).alias("c"))
    ends = edges.select("repo_id", F.explode(F.array("source", "target")).alias("c"))
    return names.unionByName(ends).select("repo_id", F.lower("c").alias("component")).distinct()


#: Letters in a gram; shorter names are looked up as they are.
GRAM = 3


def _grams(name: Column) -> Column:
    """The distinct runs of ``GRAM`` letters of a name that has so many."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(name, i, F.lit(GRAM))))


def _short_parts(name: Column) -> Column:
    """The distinct runs of fewer letters, the empty one too."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))

    def parts(n: int) -> Column:
        return F.transform(at, lambda i: F.substring(name, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *(parts(n) for n in range(1, GRAM))))


def _rarest(grams: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """(repo_id, name, gram) for the gram of each name that the fewest others have; none for a name with a gram no other has."""
    counted = grams.join(counts, ["repo_id", "gram"], "left")
    return counted.groupBy("repo_id", name).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")) \
        .filter("m.n > 0").select("repo_id", name, F.col("m.gram").alias("gram"))


def contained(names: DataFrame, others: DataFrame) -> DataFrame:
    """(repo_id, label) of the labels that some component of the repository contains or is contained in.

    A name that lies in another has all its grams there. Only grams that labels have are kept of the components; a name then
    meets the others at its rarest gram alone, where both are compared. Names below ``GRAM`` letters are met among
    the short parts of the others. The keys are (repository, gram), so one large repository is many keys.
    """
    long_label, long_component = F.length("label") >= GRAM, F.length("component") >= GRAM
    # Most repositories may have no labels at all; their components are left out before they are cut into grams.
    others = others.join(names.select("repo_id").distinct(), "repo_id", "left_semi")
    # Short rows that are much work: dealt to all tasks, not merged by their bytes.
    others = others.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo_id", "component")
    label_grams = names.filter(long_label).select("repo_id", "label", F.explode(_grams(F.col("label"))).alias("gram"))
    label_counts = label_grams.groupBy("repo_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    all_grams = others.filter(long_component).select("repo_id", "component", F.size(_grams(F.col("component"))).alias("of"),
                                                     F.explode(_grams(F.col("component"))).alias("gram"))
    grams = saved(all_grams.join(label_counts.select("repo_id", "gram"), ["repo_id", "gram"]), "component-grams")
    counts = grams.groupBy("repo_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    inside = _rarest(label_grams, "label", counts).join(grams, ["repo_id", "gram"]).filter(F.contains("component", F.col("label")))
    whole = grams.groupBy("repo_id", "component").agg(F.count(F.lit(1)).alias("known"), F.first("of").alias("of")).filter("known = of")
    whole_grams = whole.select("repo_id", "component", F.explode(_grams(F.col("component"))).alias("gram"))
    around = _rarest(whole_grams, "component", label_counts).join(label_grams, ["repo_id", "gram"]).filter(F.contains("label", F.col("component")))
    parts = others.select("repo_id", F.explode(_short_parts(F.col("component"))).alias("label")).distinct()
    short_labels = names.filter(~long_label).join(parts, ["repo_id", "label"])
    label_parts = names.select("repo_id", "label", F.explode(_short_parts(F.col("label"))).alias("component"))
    short_components = label_parts.join(others.filter(~long_component), ["repo_id", "component"])
    found = [df.select("repo_id", "label") for df in (inside, around, short_labels, short_components)]
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3]).distinct()


def unresolved_components(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Labels that no known component of the repository contains or is contained in.

    Each distinct label of a repository is judged once, whatever number of runs and diagrams has it; these are found again
    at the end. So there is no row for a component and a run, and none for a component and a label that share no gram.
    """
    keys = ["repo_id", *_run(labels)]
    open_labels = saved(labels.filter(~F.lower("label").isin(vocab.GENERIC_COMPONENTS)), "open-labels")
    names = saved(open_labels.select("repo_id", F.lower("label").alias("label")).distinct(), "label-names")
    matched = contained(names, known).withColumnRenamed("label", "_label")
    return open_labels.withColumn("_label", F.lower("label")) \
        .join(matched, ["repo_id", "_label"], "left_anti") \
        .select(*keys, "diagram", F.col("label").alias("component")).distinct()


def unresolved_in_diagrams(diagrams: DataFrame, known: DataFrame) -> DataFrame:
    """``unresolved_components`` of diagrams (repo_id, run_id, diagram, text), each distinct text of a repository read and judged once.

    All runs of a repository have the same architecture, folder and entity diagrams, so their labels are not found again for every run.
    """
    keyed = diagrams.withColumn("_text", F.sha2("text", 256))
    texts = keyed.groupBy("repo_id", "diagram", "_text").agg(F.first("text").alias("text")).withColumnRenamed("_text", "run_id")
    bad = unresolved_components(diagram_labels(texts), known).toDF("_repo_id", "_run_id", "_diagram", "component")
    same = (F.col("_text") == F.col("_run_id")) & F.col("repo_id").eqNullSafe(F.col("_repo_id")) & F.col("diagram").eqNullSafe(F.col("_diagram"))
    return keyed.join(bad, same).select("repo_id", "run_id", "diagram", "component").distinct()


def masked_sections(sections: DataFrame) -> DataFrame:
    """Sections with leaked secrets masked; ``secret_types`` lists what was found."""
    found = secrets.mask_secrets(sections, "markdown")
    return found.withColumn("markdown", F.col("masked")).drop("masked")


def validation_report(sections: DataFrame, inv: DataFrame, unresolved: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """One row per generation run: unresolved paths, unresolved diagram components, leaked secrets.

    ``unresolved`` is the output of ``unresolved_components``, ``masked`` that of ``masked_sections`` if it is at hand. The lists of a run are bounded
    by the text of its nine sections and of the diagrams of its repository.
    """
    masked = saved(masked_sections(sections), "masked-sections") if masked is None else masked
    name = F.concat("section", F.lit(".md"))
    bad_paths = unresolved_paths(path_mentions(masked), inv).groupBy("repo_id", "run_id").agg(
        F.array_sort(F.collect_list(F.struct(name.alias("section"), "path"))).alias("unresolved_file_paths"))
    leaks = masked.filter(F.size("secret_types") > 0).groupBy("repo_id", "run_id").agg(
        F.array_sort(F.collect_list(F.struct(name.alias("file"), "secret_types"))).alias("leaked_secrets_detected"))
    of_run = ["repo_id", *_run(unresolved)]
    bad_parts = unresolved.groupBy(*of_run).agg(
        F.array_sort(F.collect_list(F.struct("diagram", "component"))).alias("unresolved_diagram_components"))
    runs = sections.select("repo_id", "run_id").distinct()
    empty = {"unresolved_file_paths": "array<struct<section:string,path:string>>",
             "unresolved_diagram_components": "array<struct<diagram:string,component:string>>",
             "leaked_secrets_detected": "array<struct<file:string,secret_types:array<string>>>"}
    return runs.join(bad_paths, ["repo_id", "run_id"], "left").join(leaks, ["repo_id", "run_id"], "left") \
        .join(bad_parts, of_run, "left") \
        .select("repo_id", "run_id", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in empty.items()])


def evidence_labels(sections: DataFrame) -> DataFrame:
    """Number of confidence words and claim tags per section. Narrow."""
    counts = [F.regexp_count("markdown", F.lit(w)).alias(w.lower()) for w in vocab.CONFIDENCE_WORDS]
    counts += [F.regexp_count("markdown", F.lit(rf"\[{t}\]")).alias("tag_" + t.lower().replace("-", "_"))
               for t in vocab.CLAIM_TAGS]
    return sections.select("repo_id", "run_id", "section", *counts)
