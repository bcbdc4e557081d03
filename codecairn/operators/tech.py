"""Technology detection from manifests, source words and file extensions.

Facts are kept in long form, ``(repo_id, facet, label, src, pos)``: ``src`` ranks the
detector and ``pos`` the place inside it, so the stable order of a stack survives any
shuffle. Vocabularies are inlined as literals; no detector joins.
"""
from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import paths, text, vocab
from ..functions.lookups import array_literal, lookup, map_literal, pairs_literal
from .inventory import skip_dirs
from .ranking import top_n

# Manifest patterns, in the subset that Java and RE2 read alike.
VERSION_MARK = r"[=<>!~\[;]"
ARTIFACT = r"<artifactId>([^<]+)</artifactId>"
IMAGE = r"image:\s*(\S+)"
AI_WORDS = r"(?i)\b(" + "|".join(re.escape(w) for w in vocab.AI_SOURCE_WORDS) + r")\b"
# Detector order within a stack.
SOURCE_RANKS = {"extensions": 0, "npm": 1, "pip": 2, "pyproject": 3, "maven": 4, "gradle": 5, "compose": 6, "words": 7}


def _manifest_kinds() -> dict[str, str]:
    return {name: kind for kind, names in vocab.MANIFESTS.items() for name in names}


def _manifest_ranks() -> dict[str, int]:
    return {name: rank for names in vocab.MANIFESTS.values() for rank, name in enumerate(names)}


def find_manifests(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The first manifest of every kind per repository: by name rank, depth, then path.

    All kinds share one window. Only manifest rows reach it, and each map task keeps one row
    per (repository, kind) before the shuffle.
    """
    names = [n for k in (kinds or vocab.MANIFESTS) for n in vocab.MANIFESTS[k]]
    name = paths.name(F.col("path"))
    found = skip_dirs(files, "manifests").filter(name.isin(names)).select(
        "repo_id", lookup(name, _manifest_kinds()).alias("kind"), "path", "content",
        lookup(name, _manifest_ranks()).alias("_rank"), paths.depth(F.col("path")).alias("_depth"))
    return top_n(found, ["repo_id", "kind"], [F.col("_rank"), F.col("_depth"), F.col("path")], 1) \
        .select("repo_id", "kind", "path", "content")


def find_manifest(files: DataFrame, names: list[str]) -> DataFrame:
    """First file per repository with one of ``names`` (exact case), earlier names first."""
    name = paths.name(F.col("path"))
    ranks = {n: i for i, n in enumerate(names)}
    found = skip_dirs(files, "manifests").filter(name.isin(names))
    order = [lookup(name, ranks), paths.depth(F.col("path")), F.col("path")]
    return top_n(found, ["repo_id"], order, 1).drop("rank")


# --- dependency lists -------------------------------------------------------------------

_NPM = ("array<struct<dependencies:map<string,string>,devDependencies:map<string,string>,"
        "peerDependencies:map<string,string>>>")
_NPM_SECTIONS = ["dependencies", "devDependencies", "peerDependencies"]


def _npm_document(content: Column) -> Column:
    """Dependency sections of a package.json; null unless the text is exactly one JSON document."""
    # The brackets make trailing text an error instead of being ignored. A byte-order mark is no text.
    docs = F.from_json(F.concat(F.lit("["), F.ltrim(content, F.lit("\ufeff")), F.lit("]")), _NPM, {"allowSingleQuotes": "false"})
    return F.when(F.size(docs) == 1, F.get(docs, F.lit(0)))


def _npm_names(doc: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(F.map_keys(doc[s]), none) for s in _NPM_SECTIONS]))


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """package.json rows -> (repo_id, ord, dep, version). A later section overrides the version
    and keeps the position. Text that is not exactly one JSON document gives no rows.
    """
    parsed = manifests.select("repo_id", _npm_document(F.col("content")).alias("d"))
    deps = parsed.select("repo_id", "d", F.posexplode(_npm_names(F.col("d"))).alias("pos", "dep"))
    version = F.coalesce(*[F.try_element_at(F.col(f"d.{s}"), F.col("dep")) for s in reversed(_NPM_SECTIONS)])
    return deps.select("repo_id", (F.col("pos") + 1).alias("ord"), "dep", version.alias("version"))


def _requirement_name(line: Column) -> Column:
    return F.lower(text.strip(F.get(F.split(line, VERSION_MARK, 2), F.lit(0))))


def _pip_names(content: Column) -> Column:
    stripped = F.transform(text.lines(content), text.strip)
    wanted = F.filter(stripped, lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    return F.array_distinct(F.filter(F.transform(wanted, _requirement_name), lambda n: n != ""))


def pip_dependencies(manifests: DataFrame) -> DataFrame:
    """requirements.txt rows -> (repo_id, ord, dep): comments and version parts cut, lower case."""
    return manifests.select("repo_id", F.posexplode(_pip_names(F.col("content"))).alias("pos", "dep")) \
        .select("repo_id", (F.col("pos") + 1).alias("ord"), "dep")


def _toml_names(content: str | None) -> list[str]:
    """Dependency names of one pyproject.toml; empty when it is not valid TOML."""
    if content is None:
        return []
    try:
        doc = tomllib.loads(content)
        poetry = doc.get("tool", {}).get("poetry", {})
        listed = [*poetry.get("dependencies", {}), *poetry.get("dev-dependencies", {})]
        listed += [re.split(VERSION_MARK, d, maxsplit=1)[0].strip() for d in doc.get("project", {}).get("dependencies", [])]
    except (tomllib.TOMLDecodeError, AttributeError, TypeError):
        return []
    return list(dict.fromkeys(n.lower() for n in listed if n))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pyproject_names(content: pd.Series) -> pd.Series:
    """Spark has no TOML reader; the manifest texts, one per repository, are parsed in Arrow batches."""
    return content.map(_toml_names)


def pyproject_dependencies(manifests: DataFrame) -> DataFrame:
    """pyproject.toml rows -> (repo_id, ord, dep)."""
    parsed = manifests.select("repo_id", _pyproject_names("content").alias("deps"))
    return parsed.select("repo_id", F.posexplode("deps").alias("pos", "dep")) \
        .select("repo_id", (F.col("pos") + 1).alias("ord"), "dep")


# --- labels --------------------------------------------------------------------------------

def match_dependencies(deps: DataFrame, vocabulary: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """(repo_id, label, ord): label of the full lower-case name, else of its scope root
    (``@aws-sdk/x`` -> ``aws-sdk``); first position per label."""
    dep = F.lower("dep")
    root = F.substring_index(F.ltrim(dep, F.lit("@")), "/", 1)
    label = F.coalesce(lookup(dep, vocabulary), lookup(root, vocabulary))
    keys = ["repo_id", *(keep or [])]
    return deps.select(*keys, label.alias("label"), "ord").filter(F.col("label").isNotNull()) \
        .groupBy(*keys, "label").agg(F.min("ord").alias("ord"))


def _facet_labels(name: Column, pos: Column) -> Column:
    """Fact structs (facet, label, pos) of one dependency name over all dependency vocabularies."""
    dep = F.lower(name)
    root = F.substring_index(F.ltrim(dep, F.lit("@")), "/", 1)
    hits = F.array(*[F.struct(F.lit(facet).alias("facet"), F.coalesce(lookup(dep, v), lookup(root, v)).alias("label"),
                              pos.alias("pos")) for facet, v in vocab.DEPENDENCY_FACETS.items()])
    return F.filter(hits, lambda h: h.label.isNotNull())


def match_dependency_facets(deps: DataFrame) -> DataFrame:
    """(repo_id, facet, label, ord) for all dependency vocabularies at once; first position per label."""
    hits = deps.select("repo_id", F.explode(_facet_labels(F.col("dep"), F.col("ord"))).alias("h"))
    return hits.groupBy("repo_id", "h.facet", "h.label").agg(F.min("h.pos").alias("ord"))


_TEXT_FACETS = {"backend_frameworks": vocab.BACKEND_FRAMEWORKS, "databases": vocab.DATABASES}


def _labels_within(haystack: Column, facets: dict[str, dict[str, str]], offset: Column) -> Column:
    """Fact structs of the vocabulary keys that are substrings; checked in the row, never as a join."""
    def hits_of(facet: str) -> Column:
        found = F.filter(pairs_literal(facets[facet]), lambda v: F.contains(haystack, v.key))
        return F.transform(found, lambda v: F.struct(F.lit(facet).alias("facet"), v.label.alias("label"),
                                                     (v.pos + offset).alias("pos")))
    return F.concat(*[hits_of(f) for f in facets])


def _maven_hits(content: Column) -> Column:
    artifacts = F.regexp_extract_all(content, F.lit(ARTIFACT), F.lit(1))
    return F.flatten(F.transform(artifacts, lambda a, i: _labels_within(F.lower(a), _TEXT_FACETS, i * 1000)))


def _gradle_hits(content: Column) -> Column:
    return _labels_within(F.lower(content), _TEXT_FACETS, F.lit(0))


def _images(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(IMAGE), F.lit(1))


def _compose_hits(content: Column) -> Column:
    databases = {"databases": vocab.DATABASES}
    return F.flatten(F.transform(_images(content), lambda image, i: _labels_within(
        F.substring_index(F.lower(image), ":", 1), databases, i * 1000)))


def _first_labels(hits: DataFrame) -> DataFrame:
    return hits.groupBy("repo_id", "h.facet", "h.label").agg(F.min("h.pos").alias("pos"))


def maven_labels(manifests: DataFrame) -> DataFrame:
    """pom.xml rows -> (repo_id, facet, label, pos): vocabulary keys inside any artifactId."""
    return _first_labels(manifests.select("repo_id", F.explode(_maven_hits(F.col("content"))).alias("h")))


def gradle_labels(manifests: DataFrame) -> DataFrame:
    """Gradle build rows -> (repo_id, facet, label, pos): vocabulary keys anywhere in the text."""
    return _first_labels(manifests.select("repo_id", F.explode(_gradle_hits(F.col("content"))).alias("h")))


def container_facts(manifests: DataFrame, max_images: int = vocab.MAX_COMPOSE_IMAGES) -> DataFrame:
    """Repositories with container files: ``docker`` flag, first compose images, databases among all images."""
    compose = F.when(F.col("kind") == "compose", F.col("content"))
    boxed = manifests.filter(F.col("kind").isin("docker", "compose")).select(
        "repo_id", _images(compose).alias("images"),
        F.array_distinct(F.transform(_compose_hits(compose), lambda h: h.label)).alias("databases"))
    # At most one compose file per repository: max picks its lists over null.
    per_repo = boxed.groupBy("repo_id").agg(F.max("images").alias("images"), F.max("databases").alias("databases"))
    empty = F.array().cast("array<string>")
    return per_repo.select("repo_id", F.lit(True).alias("docker"),
                           F.coalesce(F.slice("images", 1, max_images), empty).alias("images"),
                           F.coalesce("databases", empty).alias("databases"))


def ai_labels(content: Column) -> Column:
    """Distinct AI library labels of one text."""
    return F.array_distinct(F.transform(
        F.regexp_extract_all(content, F.lit(AI_WORDS), F.lit(1)),
        lambda w: F.element_at(map_literal(vocab.AI_SOURCE_WORDS), F.lower(w))))


def ai_source_hits(files: DataFrame) -> DataFrame:
    """(repo_id, label, pos): AI libraries named as whole words in source files, in vocabulary order.

    One pass of one alternation per file; duplicates collapse in the row and again on the map side.
    """
    sources = skip_dirs(files, "sources").filter(paths.extension(F.col("path")).isin(vocab.SOURCE_EXTENSIONS))
    order = _first_positions(vocab.AI_SOURCE_WORDS.values())
    labels = F.col("ai_labels") if "ai_labels" in files.columns else ai_labels(F.col("content"))
    return sources.select("repo_id", F.explode(labels).alias("label")).distinct() \
        .withColumn("pos", lookup(F.col("label"), order))


def languages_by_extension(files: DataFrame) -> DataFrame:
    """(repo_id, language): distinct language families of the file extensions."""
    lang = lookup(paths.extension(F.col("path")), vocab.STACK_LANGUAGES)
    return skip_dirs(files, "sources").select("repo_id", lang.alias("language")) \
        .filter(F.col("language").isNotNull()).distinct()


def package_managers(files: DataFrame) -> DataFrame:
    """(repo_id, label, pos): managers of the lock and manifest names at the repository root."""
    names = list(vocab.PACKAGE_MANAGERS)
    found = files.filter(F.col("path").isin(names))  # a bare name is a root file; pushed to the scan
    label = lookup(F.col("path"), vocab.PACKAGE_MANAGERS)
    pos = lookup(F.col("path"), {n: i for i, n in enumerate(names)})
    return found.select("repo_id", label.alias("label"), pos.alias("pos")) \
        .groupBy("repo_id", "label").agg(F.min("pos").alias("pos"))


# --- stack -----------------------------------------------------------------------------------

DOCKER = "docker"  # facet of the container flag
_SEEN = ""         # facet of a marker that a repository exists


def _fact(facet, label, pos=0) -> Column:
    facet, label, pos = [x if isinstance(x, Column) else F.lit(x) for x in (facet, label, pos)]
    return F.struct(facet.alias("facet"), label.alias("label"), pos.cast("int").alias("pos"))


def _manifest_facts(manifests: DataFrame) -> DataFrame:
    """All facts of all manifests: every text is parsed once, by its kind, and exploded once."""
    kind, content = F.col("kind"), F.col("content")
    parsed = manifests.select(
        "repo_id", "kind", "content", F.when(kind == "npm", _npm_names(_npm_document(content)))
        .when(kind == "pip", _pip_names(content)).alias("names"),
        # Other kinds reach the Python worker as nulls.
        _pyproject_names(F.when(kind == "pyproject", content)).alias("toml"))
    names = F.when(kind == "pyproject", F.col("toml")).otherwise(F.col("names"))
    typed = parsed.select("repo_id", "kind", "content", names.alias("names"))
    from_names = F.flatten(F.transform("names", lambda n, i: _facet_labels(n, i + 1)))
    from_text = F.when(kind == "maven", _maven_hits(content)).when(kind == "gradle", _gradle_hits(content)) \
        .when(kind == "compose", _compose_hits(content))
    typescript = F.exists("names", lambda n: (n == "typescript") | F.startswith(n, F.lit("@types/")))
    none = F.array().cast("array<struct<facet:string,label:string,pos:int>>")
    language = lookup(kind, vocab.MANIFEST_LANGUAGES)
    facts = F.concat(
        F.when(language.isNotNull(), F.array(_fact("languages", language))).otherwise(none),
        F.when((kind == "npm") & typescript, F.array(_fact("languages", "TypeScript", 1))).otherwise(none),
        F.when(kind.isin("docker", "compose"), F.array(_fact(DOCKER, "yes"))).otherwise(none),
        F.coalesce(from_names, none), F.coalesce(from_text, none))
    return typed.select("repo_id", F.coalesce(lookup(kind, SOURCE_RANKS), F.lit(SOURCE_RANKS["compose"])).alias("src"),
                        F.explode(facts).alias("f"))


def _file_facts(files: DataFrame, assume_languages: bool) -> DataFrame:
    """Facts that single files show: language family, AI words, package manager; and that the repository exists."""
    path, parts, ext = F.col("path"), paths.parts(F.col("path")), paths.extension(F.col("path"))
    swept = ~F.arrays_overlap(parts, array_literal(vocab.SKIP_DIRS["sources"]))
    language = lookup(ext, vocab.STACK_LANGUAGES)
    order = _first_positions(vocab.AI_SOURCE_WORDS.values())
    labels = F.col("ai_labels") if "ai_labels" in files.columns else ai_labels(F.col("content"))
    managers = {n: i for i, n in enumerate(vocab.PACKAGE_MANAGERS)}
    none = F.array().cast("array<struct<src:int,fact:struct<facet:string,label:string,pos:int>>>")

    def one(src: str, fact: Column) -> Column:
        return F.struct(F.lit(SOURCE_RANKS[src]).alias("src"), fact.alias("fact"))

    words = F.transform(labels, lambda w: one("words", _fact("ai_llm_libraries", w, lookup(w, order))))
    assumed = [one(k, _fact("languages", name)) for k, name in vocab.MANIFEST_LANGUAGES.items()] if assume_languages else []
    facts = F.concat(
        F.array(one("extensions", _fact(_SEEN, "")), *assumed),
        # Position 0 for all: alphabetical order comes from the label itself.
        F.when(swept & language.isNotNull(), F.array(one("extensions", _fact("languages", language)))).otherwise(none),
        F.when(swept & ext.isin(vocab.SOURCE_EXTENSIONS), words).otherwise(none),
        F.when(path.isin(list(managers)), F.array(one("extensions", _fact(
            "package_managers", lookup(path, vocab.PACKAGE_MANAGERS), lookup(path, managers))))).otherwise(none))
    return files.select("repo_id", F.explode(facts).alias("x")).select("repo_id", "x.src", F.col("x.fact").alias("f"))


def _first_positions(labels) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, label in enumerate(labels):
        out.setdefault(label, i)
    return out


def _all_facts(files: DataFrame, assume_languages: bool) -> DataFrame:
    found = _manifest_facts(find_manifests(files)).unionByName(_file_facts(files, assume_languages))
    # Source rank and position in one number, so the combine is a plain hash aggregate.
    at = F.col("src").cast("bigint") * F.lit(1 << 40) + F.col("f.pos")
    first = found.groupBy("repo_id", "f.facet", "f.label").agg(F.min(at).alias("at"))
    return first.select("repo_id", "facet", "label", F.shiftright("at", 40).cast("int").alias("src"),
                        F.col("at").bitwiseAND((1 << 40) - 1).cast("int").alias("pos"))


def tech_facts(files: DataFrame, assume_languages: bool = False) -> DataFrame:
    """All facts of every repository in long form, first position per (repository, facet, label).

    Two passes, one over the manifests and one over all files, and one combine.
    ``assume_languages`` adds JavaScript, Python, Java and Java/Kotlin to every repository,
    also without a manifest.
    """
    return _all_facts(files, assume_languages).filter(F.col("facet") != _SEEN)


def tech_stack(files: DataFrame, assume_languages: bool = False) -> DataFrame:
    """Wide form: one array per facet in detection order, and the docker flag; a row for every repository.

    The arrays are short by construction: every label comes from a vocabulary.
    """
    entry = F.struct("src", "pos", "label")
    cols = [F.array_sort(F.collect_list(F.when(F.col("facet") == f, entry))).alias(f) for f in vocab.FACETS]
    wide = _all_facts(files, assume_languages).groupBy("repo_id").agg(*cols, F.bool_or(F.col("facet") == DOCKER).alias("docker"))
    return wide.select("repo_id", *[F.col(f"{f}.label").alias(f) for f in vocab.FACETS], "docker")


def with_external_apis(stack: DataFrame, apis: DataFrame) -> DataFrame:
    """Adds the external API targets (at most 50 per repository) to the wide form."""
    lists = apis.groupBy("repo_id").agg(F.array_sort(F.collect_list("target")).alias("external_apis_detected"))
    empty = F.array().cast("array<string>")
    return stack.join(lists, "repo_id", "left") \
        .withColumn("external_apis_detected", F.coalesce("external_apis_detected", empty))


def tech_summary(stack: DataFrame) -> DataFrame:
    """Only the non-empty facets, long form: (repo_id, facet, labels)."""
    facets = [f for f in [*vocab.FACETS, "external_apis_detected"] if f in stack.columns]
    entries = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("labels")) for f in facets])
    return stack.select("repo_id", F.explode(F.filter(entries, lambda e: F.size(e.labels) > 0)).alias("e")) \
        .select("repo_id", "e.facet", "e.labels")
