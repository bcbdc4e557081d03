"""Imports, HTTP calls, route declarations and ORM use found in source files by regular expressions.

Work is per file: the text is cut into lines, lines with a keyword are matched, and the
edges of one file are one array, deduplicated in place and exploded once. So
``relationships`` is a single pass over the scan without any shuffle, however large one
repository is.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, text, vocab
from .inventory import skip_dirs, source_files
from .ranking import top_n

# Patterns in the subset that Java and RE2 read alike. Only white space may hold a line end.
PATTERNS = {
    "js_import": r"""import\s+[^\n\f]*?from\s+['"][^'"\n\f]+['"]|require\s*\(\s*['"][^'"\n\f]+['"]\s*\)""",
    "js_dynamic_import": r"""import\s*\(\s*['"]([^'"\n\f]+)['"]\s*\)""",
    "js_http": r"""(?i)\b(?:axios|fetch)\s*\.?\s*(?:get|post|put|patch|delete|request)?\s*\(\s*['"`]([^'"`\n\f]+)['"`]""",
    "js_route": r"""(?i)\b(?:app|router)\s*\.\s*(get|post|put|patch|delete|all|use)\s*\(\s*['"`]([^'"`\n\f]+)['"`]""",
    "py_import": r"""^import[ \t]+([A-Za-z0-9_., \t]+)""",
    "py_from": r"""^from[ \t]+([A-Za-z0-9_.]+)[ \t]+import[ \t]""",
    "py_requests": r"""(?i)requests\s*\.\s*(?:get|post|put|patch|delete|head|options)\s*\(\s*f?['"]([^'")\n\f]{3,120})""",
    "py_httpx": r"""(?i)httpx\s*\.\s*(?:get|post|put|patch|delete)\s*\(\s*['"]([^'")\n\f]{3,120})['"]""",
    "py_route": r"""(?i)@(?:app|router)\s*\.\s*(get|post|put|patch|delete)\s*\(\s*['"]([^'"\n\f]+)['"]""",
    "flask_route": r"""(?i)@(?:app|bp|blueprint)\s*\.route\s*\(\s*['"]([^'"\n\f]+)['"]""",
    "django_url": r"""\b(?:path|re_path|url)\s*\(\s*r?['"]([^'"\n\f]+)['"]""",
    "orm": r"""session\.(?:add|query|get|execute|merge)\(|db\.session\.|Base\.metadata""",
}
QUOTED_TAIL = r"""['"]([^'"]+)['"]\s*\)?$"""
# Extractor number -> (relationship, operator); the number is the order of edges within a file.
EXTRACTORS = {
    1: ("imports", "js_import"), 2: ("imports", "js_dynamic_import"), 3: ("calls_api", "js_http"),
    4: ("declares_route", "js_route"), 5: ("imports", "py_import"), 6: ("calls_api", "py_requests"),
    7: ("calls_api", "py_httpx"), 8: ("declares_route", "py_route"), 9: ("declares_route", "flask_route"),
    10: ("declares_route", "django_url"), 11: ("uses_model", "orm"),
}
# A line without any of these words cannot match any pattern of its language.
JS_KEYWORDS = r"(?i)import|require|axios|fetch|app|router"
PY_KEYWORDS = r"(?i)import|requests|httpx|@|path|url|session|metadata"
# A line that ends like this may begin a match that later lines complete: a name, with or without '.', verb and '('.
OPEN_END = r"""(?i)\b(?:axios|fetch|import|from|require|app|router|bp|blueprint|requests|httpx|path|re_path|url)\s*\.?\s*\w*\s*\(?\s*$"""
#: Lines with text that a match can go on over: each of name, '.', verb, '(' and literal on one of its own.
FURTHER_LINES = 4
#: Stands for the end of the first of several lines; white space to every pattern.
FIRST_END = "\f"


def _all(line: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(line, F.lit(PATTERNS[pattern]), F.lit(group))


def _verb_targets(line: Column, pattern: str) -> Column:
    """``VERB path`` for patterns with the verb in group 1 and the path in group 2."""
    return F.zip_with(_all(line, pattern, 1), _all(line, pattern, 2),
                      lambda verb, route: F.concat(F.upper(verb), F.lit(" "), route))


def _import_names(line: Column) -> Column:
    """``import a, b as c`` -> [a, b]."""
    listed = F.split(F.regexp_extract(line, PATTERNS["py_import"], 1), ",")
    names = F.transform(listed, lambda m: text.strip(F.substring_index(text.strip(m), " as ", 1)))
    return F.concat(F.filter(names, lambda m: m != ""), _all(line, "py_from"))


def _targets(line: Column, extractor: int) -> Column:
    """Targets one extractor finds on one line, in match order."""
    if extractor == 1:
        return F.transform(_all(line, "js_import", 0), _quoted)
    if extractor in (4, 8):
        return _verb_targets(line, EXTRACTORS[extractor][1])
    if extractor == 5:
        return _import_names(line)
    if extractor in (6, 7):
        return F.transform(_all(line, EXTRACTORS[extractor][1]), text.strip)
    if extractor == 9:
        return F.transform(_all(line, "flask_route"), lambda t: F.concat(F.lit("ROUTE "), t))
    if extractor == 10:
        return F.transform(_all(line, "django_url"), lambda t: F.concat(F.lit("URL "), t))
    if extractor == 11:
        return F.transform(_all(line, "orm", 0), lambda t: F.rtrim(t, F.lit("(")))
    return _all(line, EXTRACTORS[extractor][1])


def _quoted(match: Column) -> Column:
    return F.regexp_extract(match, QUOTED_TAIL, 1)


def _spanning_targets(several: Column, extractor: int) -> Column:
    """The target of the match that begins on the first of several lines and ends on a later one, if there is one."""
    matches = _all(several, EXTRACTORS[extractor][1], 0)
    over = F.filter(F.zip_with(matches, _targets(several, extractor), lambda m, t: F.struct(m.alias("m"), t.alias("t"))),
                    lambda x: F.contains(x.m, F.lit(FIRST_END)))
    return F.transform(over, lambda x: x.t)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _edges_of_lines(content: Column, keywords: str, extractors: list[int]) -> Column:
    """``array<struct<relationship, target, extractor, line, pos, evidence>>`` of one text.

    Every line is matched by itself, under its own number. Where its end leaves a call open, it is matched once more
    together with the next lines that have text, and what spans its end counts for it. So nothing that a comment or a literal holds
    hides a line, and an import is only ever looked for at the beginning of a line of the file.
    """
    numbered = F.transform(F.split(F.translate(content, FIRST_END, " "), "\n"),
                           lambda line, i: F.struct((i + 1).alias("no"), line.alias("text")))
    with_text = F.filter(numbered, lambda x: text.strip(x.text) != "")

    def edges(lines: Column) -> Column:
        placed = F.transform(lines, lambda x, i: F.struct(x.no.alias("no"), x.text.alias("text"), i.alias("i")))
        candidates = F.filter(placed, lambda x: F.rlike(x.text, F.lit(keywords)))
        opened = F.transform(candidates, lambda x: F.struct(
            x.no.alias("no"), x.text.alias("text"), F.when(F.rlike(x.text, F.lit(OPEN_END)), F.concat(
                x.text, F.lit(FIRST_END), F.array_join(F.transform(F.slice(lines, x.i + 2, F.lit(FURTHER_LINES)), lambda y: y.text), "\n"))).alias("several")))
        return F.flatten(F.transform(opened, lambda x: F.concat(*[_line_edges(x, e) for e in extractors])))

    return _let(with_text, edges)


def _line_edges(x: Column, extractor: int) -> Column:
    """Edges one extractor finds on one numbered line, and from it on over the next ones."""
    targets = _targets(x.text, extractor)
    if extractor not in (5, 11):  # imports stand on one line, and so do uses of a session
        none = F.array().cast("array<string>")
        targets = F.concat(targets, F.when(x.several.isNotNull(), _spanning_targets(x.several, extractor)).otherwise(none))
    return F.transform(targets, lambda target, pos: F.struct(
        F.lit(EXTRACTORS[extractor][0]).alias("relationship"), target.alias("target"),
        F.lit(extractor).alias("extractor"), x.no.alias("line"), (pos + 1).alias("pos"),
        text.evidence(x.text).alias("evidence")))


def first_per_target(edges: Column) -> Column:
    """Of an array sorted by (relationship, target, position), the first edge per (relationship, target)."""
    return F.filter(edges, lambda e, i: (i == 0)
                    | (e.relationship != F.get(edges, i - 1).relationship)
                    | (e.target != F.get(edges, i - 1).target))


def _is_python() -> Column:
    return paths.extension(F.col("path")) == ".py"


_FILE_COLUMNS = ("content", "size", "edges", "secret_types", "ai_labels")


def edge_array(extractors: list[int] | None = None) -> Column:
    """All edges of one source file as an array, over the columns path and content."""
    wanted = extractors or list(EXTRACTORS)
    return F.when(_is_python(), _edges_of_lines(F.col("content"), PY_KEYWORDS, [e for e in wanted if e >= 5])) \
        .otherwise(_edges_of_lines(F.col("content"), JS_KEYWORDS, [e for e in wanted if e < 5]))


def _edge_rows(files: DataFrame, extractors: list[int], dedupe: bool) -> DataFrame:
    py = [e for e in extractors if e >= 5]
    js = [e for e in extractors if e < 5]
    if "edges" in files.columns:
        edges = F.filter("edges", lambda e: e.extractor.isin(extractors))
    elif js and py:
        edges = edge_array(extractors)
    elif py:
        files, edges = files.filter(_is_python()), _edges_of_lines(F.col("content"), PY_KEYWORDS, py)
    else:
        files, edges = files.filter(~_is_python()), _edges_of_lines(F.col("content"), JS_KEYWORDS, js)
    # Watermark columns of a stream pass through untouched.
    extra = [c for c in files.columns if c not in ("repo_id", "path", *_FILE_COLUMNS)]
    kept = [F.col("repo_id"), F.col("path").alias("source"), *extra]
    # The generator gets an expression, not a column: over a column the optimizer adds a
    # "not empty" filter below it, which would run the whole extraction a second time.
    if dedupe:
        rows = files.select(*kept, F.sort_array(edges).alias("edges")) \
            .select("repo_id", "source", *extra, F.explode(first_per_target(F.col("edges"))).alias("e"))
    else:
        rows = files.select(*kept, F.explode(edges).alias("e"))
    return rows.select("repo_id", "source", "e.relationship", "e.target", "e.evidence", "e.extractor", "e.line", "e.pos",
                       *extra)


def extract(files: DataFrame, extractors: list[int], dedupe: bool = False) -> DataFrame:
    """Edges of the given extractors from the source files outside skipped folders."""
    kept = skip_dirs(files, "relations")
    # A table of facts has its edges already, and only the text that is used again.
    sources = kept.filter("edges is not null") if "edges" in files.columns else source_files(kept)
    return _edge_rows(sources, extractors, dedupe)


def js_imports(files: DataFrame) -> DataFrame:
    return extract(files, [1])


def js_dynamic_imports(files: DataFrame) -> DataFrame:
    return extract(files, [2])


def js_http_calls(files: DataFrame) -> DataFrame:
    return extract(files, [3])


def js_routes(files: DataFrame) -> DataFrame:
    return extract(files, [4])


def py_imports(files: DataFrame) -> DataFrame:
    return extract(files, [5])


def py_requests_calls(files: DataFrame) -> DataFrame:
    return extract(files, [6])


def py_httpx_calls(files: DataFrame) -> DataFrame:
    return extract(files, [7])


def py_decorator_routes(files: DataFrame) -> DataFrame:
    return extract(files, [8])


def flask_routes(files: DataFrame) -> DataFrame:
    return extract(files, [9])


def django_urls(files: DataFrame) -> DataFrame:
    return extract(files, [10])


def orm_usage(files: DataFrame) -> DataFrame:
    return extract(files, [11])


def relationships(files: DataFrame) -> DataFrame:
    """All edges, first per (source, relationship, target). Needs one row per (repo_id, path)."""
    return extract(files, list(EXTRACTORS), dedupe=True)


def dedupe_relationships(edges: DataFrame) -> DataFrame:
    """First edge per (repo, source, relationship, target) of any edge table.

    For tables that do not come from ``relationships``, e.g. with repeated deliveries of a
    file. The group key includes the file, so one large repository spreads over all tasks,
    and repeats collapse on the map side.
    """
    keys = ["repo_id", "source", "relationship", "target"]
    w = Window.partitionBy(*keys).orderBy("extractor", "line", "pos")
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def relationships_of(edges: DataFrame, kind: str, limit: int) -> DataFrame:
    """First edges of one kind per repository, in path-part, extractor and position order."""
    order = [paths.parts(F.col("source")), F.col("extractor"), F.col("line"), F.col("pos"), F.col("target")]
    return top_n(edges.filter(F.col("relationship") == kind), ["repo_id"], order, limit)


def external_apis(edges: DataFrame, limit: int = vocab.MAX_EXTERNAL_APIS) -> DataFrame:
    """Distinct absolute and ``/api/`` call targets per repository, first by name."""
    target = F.col("target")
    outside = reduce(or_, [F.startswith(target, F.lit(p)) for p in ("http://", "https://", "/api/")])
    calls = edges.filter((F.col("relationship") == "calls_api") & outside)
    return top_n(calls.select("repo_id", "target").distinct(), ["repo_id"], [target], limit)
