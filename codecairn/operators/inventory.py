"""Path filters, language, category and the file inventory. All narrow unless noted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, vocab
from ..functions.lookups import array_literal, contains_any, lookup, overlaps
from .ranking import top_n


def path_parts(df: DataFrame, col: str = "path") -> DataFrame:
    """Adds name, stem, extension, dirs, depth and top_dir."""
    p = F.col(col)
    return df.select(
        "*", paths.name(p).alias("name"), paths.stem(p).alias("stem"), paths.extension(p).alias("extension"),
        paths.dirs(p).alias("dirs"), paths.depth(p).alias("depth"), paths.top_dir(p).alias("top_dir"))


def skip_dirs(df: DataFrame, purpose: str = "inventory", dirs: list[str] | None = None,
              match: str | None = None) -> DataFrame:
    """Drops rows below dependency and build folders.

    ``purpose`` names one of the built-in sets; ``dirs`` overrides it. The inventory set
    looks at folders only (``match="dirs"``), the others also at the file name
    (``match="any_part"``).
    """
    return df.filter(outside(purpose, dirs, match))


def outside(purpose: str = "inventory", dirs: list[str] | None = None, match: str | None = None, path: Column | None = None) -> Column:
    """Whether ``path`` is outside the folders that ``skip_dirs`` drops."""
    names = vocab.SKIP_DIRS[purpose] if dirs is None else dirs
    match = match or ("dirs" if purpose == "inventory" and dirs is None else "any_part")
    path = F.col("path") if path is None else path
    col = paths.dirs(path) if match == "dirs" else paths.parts(path)
    return ~F.arrays_overlap(col, array_literal(names))


def source_files(df: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Keeps source extensions with some text. The path test comes first, it is the cheap one."""
    wanted = paths.extension(F.col("path")).isin(extensions or vocab.SOURCE_EXTENSIONS)
    return df.filter(wanted).filter(F.length("content") > 0)


def safe_paths(df: DataFrame) -> DataFrame:
    """Normalises paths and drops those that leave the repository root."""
    return df.withColumn("path", paths.normalise(F.col("path"))).filter(F.col("path").isNotNull())


def strip_repo_root(files: DataFrame) -> DataFrame:
    """Removes a single top folder that wraps the whole repository.

    One small row per repository is computed with a map-side combine, then joined back.
    No broadcast is forced: the optimizer broadcasts it while it is small, and
    otherwise sort-merges with runtime skew splitting for a huge repository. For files with their whole text use
    ``plans.analysis``, which takes the folder off the facts instead.
    """
    top = F.coalesce(paths.top_dir(F.col("path")), F.lit(""))  # '' stands for a root file
    first = F.substring_index("path", "/", 1)
    # Distinct top folders by hash first: few rows are left for the minimum over strings.
    tops = files.filter(~first.isin(vocab.SKIP_DIRS["inventory"])).select("repo_id", top.alias("_top")).distinct()
    roots = (tops.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"), F.first("_top").alias("_root"))
             .filter("_n = 1 and _root <> ''").select("repo_id", "_root"))
    prefix = F.concat("_root", F.lit("/"))
    inside = F.col("_root").isNotNull() & F.startswith("path", prefix)
    return (files.join(roots, "repo_id", "left")
            # Files beside the wrapper can only lie in skipped folders; they are not part of the root.
            .filter(F.col("_root").isNull() | inside)
            .withColumn("path", F.when(inside, F.substring(F.col("path"), F.length(prefix) + 1, F.length("path")))
                        .otherwise(F.col("path")))
            .drop("_root"))


def language_of(path: Column) -> Column:
    """Complete lower-case file name first, then extension."""
    base = F.lower(paths.name(path))
    return F.coalesce(lookup(base, vocab.LANGUAGES), lookup(paths.extension(path), vocab.LANGUAGES),
                      F.lit(vocab.UNKNOWN_LANGUAGE))


def with_language(df: DataFrame) -> DataFrame:
    return df.withColumn("language", language_of(F.col("path")))


def category_of(path: Column) -> Column:
    """First match wins: test, doc, config, model, backend_route, frontend_component, other."""
    base, stem, ext = F.lower(paths.name(path)), F.lower(paths.stem(path)), paths.extension(path)
    folders = F.split(F.lower(path), "/")
    return (
        F.when(contains_any(base, vocab.TEST_WORDS) | overlaps(folders, vocab.TEST_FOLDERS), "test")
        .when(ext.isin(vocab.DOC_EXTENSIONS) | overlaps(folders, vocab.DOC_FOLDERS), "doc")
        .when(base.isin(vocab.CONFIG_NAMES) | ext.isin(vocab.CONFIG_EXTENSIONS), "config")
        .when(contains_any(stem, vocab.MODEL_WORDS) | overlaps(folders, vocab.MODEL_FOLDERS), "model")
        .when(contains_any(stem, vocab.BACKEND_WORDS) | overlaps(folders, vocab.BACKEND_FOLDERS), "backend_route")
        .when(ext.isin(vocab.FRONTEND_EXTENSIONS)
              | (overlaps(folders, vocab.FRONTEND_FOLDERS) & ext.isin(vocab.FRONTEND_FOLDER_EXTENSIONS)),
              "frontend_component")
        .otherwise("other"))


def with_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", category_of(F.col("path")))


def inventory(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per file outside skipped folders: path, extension, language, size, category, included.

    A single projection over the scan. Without ``keep`` the content column is only read for
    its size, and not at all when the input already has a ``size``.
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("content").cast("bigint")
    p = F.col("path")
    return skip_dirs(files).select(
        "repo_id", "path", paths.extension(p).alias("extension"), language_of(p).alias("language"),
        size.alias("size"), category_of(p).alias("category"), F.lit(True).alias("included"), *(keep or []))


def directory_summary(inv: DataFrame, max_dirs: int = 20, max_langs: int = 5) -> DataFrame:
    """Per top folder: file count and its first distinct languages in path order; first folders by name.

    Grouping by language first keeps the collected list as short as the language table.
    """
    top = F.coalesce(paths.top_dir(F.col("path")), F.lit("(root)"))
    per_lang = inv.groupBy("repo_id", top.alias("top_dir"), "language").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
    per_dir = per_lang.groupBy("repo_id", "top_dir").agg(
        F.sum("n").alias("files"),
        F.array_sort(F.collect_list(F.struct("first_path", "language"))).alias("langs"))
    ranked = top_n(per_dir, ["repo_id"], [F.col("top_dir")], max_dirs)
    return ranked.select("repo_id", "rank", "top_dir", "files",
                         F.slice(F.col("langs.language"), 1, max_langs).alias("languages"))


def file_counts(inv: DataFrame) -> DataFrame:
    return inv.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
