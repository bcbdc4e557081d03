"""The DuckDB side of the checks: one SQL text per registered query, over the given tables.

Written from the described semantics in plain SQL. Only fixed values (word lists, patterns)
come from the package, so both sides agree on the vocabulary and on nothing else.
"""
from __future__ import annotations

import re

from codecairn import fixtures
from codecairn.functions import text, vocab
from codecairn.operators import relations, scoring, secrets, tech


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values(rows) -> str:
    def one(v):
        return q(v) if isinstance(v, str) else ("TRUE" if v is True else "FALSE" if v is False else str(v))
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


def has_word(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def no_dirs(col: str, purpose: str) -> str:
    return f"NOT list_has_any({col}, {arr(vocab.SKIP_DIRS[purpose])})"


def rule_sql(r) -> str:
    tests = []
    if r.names:
        tests.append(f"lname IN {in_list(r.names)}")
    if r.parts:
        tests.append(f"list_has_any(lparts, {arr(r.parts)})")
    if r.folders:
        tests.append(f"list_has_any(lparts[1:len(lparts) - 1], {arr(r.folders)})")
    if r.stem_has:
        tests.append(has_word("lstem", r.stem_has))
    if r.name_has:
        tests.append(has_word("lname", r.name_has))
    if r.stem_starts:
        tests.append(f"starts_with(lstem, {q(r.stem_starts)})")
    hit = "(" + " OR ".join(tests) + ")"
    return f"({hit} AND extension IN {in_list(r.exts)})" if r.exts else hit


WS = "chr(32) || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


P = relations.PATTERNS
VERBS = "list_transform(range(1, len(regexp_extract_all(t, {p}, 1)) + 1), lambda i: upper(regexp_extract_all(t, {p}, 1)[i]) || ' ' || regexp_extract_all(t, {p}, 2)[i])"


def found(extractor: int, t: str) -> str:
    """The targets that a text of one or more lines has."""
    key = relations.EXTRACTORS[extractor][1]
    p = q(P[key])
    if extractor == 1:
        return f"list_transform(regexp_extract_all({t}, {p}, 0), lambda m: regexp_extract(m, {q(relations.QUOTED_TAIL)}, 1))"
    if extractor in (4, 8):
        return VERBS.replace("{p}", p).replace("(t,", f"({t},")
    if extractor == 5:
        return (f"list_filter(list_transform(string_split(regexp_extract({t}, {p}, 1), ','), "
                f"lambda m: {strip('split_part(' + strip('m') + ', chr(32) || chr(97) || chr(115) || chr(32), 1)')}), lambda m: m <> '') "
                f"|| regexp_extract_all({t}, {q(P['py_from'])}, 1)")
    if extractor in (6, 7):
        return f"list_transform(regexp_extract_all({t}, {p}, 1), lambda m: {strip('m')})"
    if extractor in (9, 10):
        return f"list_transform(regexp_extract_all({t}, {p}, 1), lambda m: '{'ROUTE' if extractor == 9 else 'URL'} ' || m)"
    if extractor == 11:
        return f"list_transform(regexp_extract_all({t}, {p}, 0), lambda m: rtrim(m, '('))"
    return f"regexp_extract_all({t}, {p}, 1)"


def line_targets(extractor: int) -> str:
    if extractor in (5, 11):
        return found(extractor, "t")
    p = q(P[relations.EXTRACTORS[extractor][1]])
    return f"({found(extractor, 'here')})[1:len(regexp_extract_all(here, {p}, 0)) - len(regexp_extract_all(later, {p}, 0))]"


def edge_sql(extractor: int) -> str:
    lang = "extension = '.py'" if extractor >= 5 else "extension <> '.py'"
    return (f"SELECT repo_id, source, '{relations.EXTRACTORS[extractor][0]}' AS relationship, target, "
            f"substring({strip('t')}, 1, 200) AS evidence, {extractor} AS extractor, line, pos FROM ("
            f"SELECT repo_id, source, t, line, unnest(tg) AS target, unnest(range(1, len(tg) + 1)) AS pos "
            f"FROM (SELECT *, {line_targets(extractor)} AS tg FROM src_lines WHERE {lang}))")


def dep_facts(deps: str, src: int) -> str:
    out = []
    for facet, v in vocab.DEPENDENCY_FACETS.items():
        voc = values(v.items())
        out.append(f"SELECT d.repo_id, '{facet}' AS facet, coalesce(a.label, b.label) AS label, {src} AS src, d.ord AS pos "
                   f"FROM {deps} d LEFT JOIN {voc} a(k, label) ON lower(d.dep) = a.k "
                   f"LEFT JOIN {voc} b(k, label) ON split_part(ltrim(lower(d.dep), '@'), '/', 1) = b.k "
                   f"WHERE coalesce(a.label, b.label) IS NOT NULL")
    return " UNION ALL ".join(out)


def masked_sql(table: str, keys: str, col: str) -> str:
    """(keys, masked): spans of all rules on the text, islands of overlapping ones, and what is between the islands."""
    def spans(pattern: str) -> str:
        cut = f"string_split(regexp_replace(replace({col}, chr(2), ' '), {q(pattern)}, '\\1' || chr(2) || '\\2' || chr(2) || '\\3', 'g'), chr(2))"
        size = lambda i: f"coalesce(list_sum(list_transform(p[1:{i}], lambda x: length(x))), 0)"
        return f"list_transform([{cut}], lambda p: list_transform(range(2, len(p) + 1, 2), lambda i: {{'a': {size('i - 1')}, 'b': {size('i')}}}))[1]"

    return f"""SELECT {keys}, {col} AS whole, coalesce(o.t, {col}) AS masked FROM {table} LEFT JOIN (
        SELECT {keys}, string_agg(substring({col}, CAST(before + 1 AS BIGINT), CAST(a - before AS BIGINT)) || '{secrets.MASK}', '' ORDER BY a) || substring(any_value({col}), CAST(max(b) + 1 AS BIGINT)) AS t FROM (
          SELECT {keys}, {col}, min(a) AS a, max(b) AS b, coalesce(lag(max(b)) OVER (PARTITION BY {keys} ORDER BY min(a)), 0) AS before FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY a, b) AS island FROM (
              SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
                SELECT DISTINCT {keys}, {col}, s.a AS a, s.b AS b FROM (SELECT {keys}, {col}, unnest({" || ".join(spans(r.pattern) for r in secrets.RULES)}) AS s FROM {table}))))
          GROUP BY {keys}, {col}, island)
        GROUP BY {keys}) o USING ({keys})"""


TEXT_VOCAB = [(f, k, l, i) for f in ("backend_frameworks", "databases")
              for i, (k, l) in enumerate(vocab.DEPENDENCY_FACETS[f].items())]
MANIFEST_NAMES = [(n, k, r) for k, ns in vocab.MANIFESTS.items() for r, n in enumerate(ns)]
AI_ORDER = {}
for _i, _l in enumerate(vocab.AI_SOURCE_WORDS.values()):
    AI_ORDER.setdefault(_l, _i)
RANK = tech.SOURCE_RANKS

# Common table expressions in dependency order; compose() adds the ones a query names.
CTES: dict[str, str] = {
    "files": fixtures.FILES_SQL,
    "sections": fixtures.SECTIONS_SQL,
    "status_log": fixtures.STATUS_LOG_SQL,
    "projects": fixtures.PROJECTS_SQL,
    "parts0": """SELECT *, string_split(path, '/') AS parts, regexp_extract(path, '[^/]*$') AS name FROM files""",
    "paths": """SELECT *, regexp_replace(name, '(.)\\.[^.]+$', '\\1') AS stem,
        lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS extension, parts[1:len(parts) - 1] AS dirs,
        len(parts) AS depth, CASE WHEN len(parts) > 1 THEN parts[1] END AS top_dir,
        lower(name) AS lname, list_transform(parts, lambda x: lower(x)) AS lparts FROM parts0""",
    "lang": f"SELECT p.*, lower(stem) AS lstem, coalesce(a.l, b.l, 'Unknown') AS language FROM paths p "
            f"LEFT JOIN {values(vocab.LANGUAGES.items())} a(k, l) ON p.lname = a.k "
            f"LEFT JOIN {values(vocab.LANGUAGES.items())} b(k, l) ON p.extension = b.k",
    "cat": f"""SELECT *, CASE
        WHEN contains(lname, 'test') OR contains(lname, 'spec') OR list_has_any(lparts, {arr(vocab.TEST_FOLDERS)}) THEN 'test'
        WHEN extension IN {in_list(vocab.DOC_EXTENSIONS)} OR list_has_any(lparts, {arr(vocab.DOC_FOLDERS)}) THEN 'doc'
        WHEN lname IN {in_list(vocab.CONFIG_NAMES)} OR extension IN {in_list(vocab.CONFIG_EXTENSIONS)} THEN 'config'
        WHEN {has_word('lstem', vocab.MODEL_WORDS)} OR list_has_any(lparts, {arr(vocab.MODEL_FOLDERS)}) THEN 'model'
        WHEN {has_word('lstem', vocab.BACKEND_WORDS)} OR list_has_any(lparts, {arr(vocab.BACKEND_FOLDERS)}) THEN 'backend_route'
        WHEN extension IN {in_list(vocab.FRONTEND_EXTENSIONS)} OR (list_has_any(lparts, {arr(vocab.FRONTEND_FOLDERS)})
          AND extension IN {in_list(vocab.FRONTEND_FOLDER_EXTENSIONS)}) THEN 'frontend_component'
        ELSE 'other' END AS category FROM lang""",
    "inv": f"SELECT *, CAST(strlen(content) AS BIGINT) AS size FROM cat WHERE {no_dirs('dirs', 'inventory')}",
    "hits": "SELECT repo_id, path, r.no, r.score, r.reason FROM (SELECT *, ["
            + ", ".join(f"CASE WHEN {rule_sql(r)} THEN {i} END" for i, r in enumerate(scoring.RULES, 1))
            + f"] AS rule_nos FROM inv) i JOIN {values([(i, r.score, r.reason) for i, r in enumerate(scoring.RULES, 1)])}"
              " r(no, score, reason) ON list_contains(i.rule_nos, r.no)",
    "running": "SELECT *, coalesce(sum(score) OVER (PARTITION BY repo_id, path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hits",
    "scored": "SELECT i.repo_id, i.path, i.language, i.category, i.content, CAST(coalesce(s.total, 0) AS BIGINT) AS score, "
              "coalesce(s.reason, 'Matched heuristic') AS reason_important FROM inv i LEFT JOIN (SELECT repo_id, path, sum(score) AS total, "
              "max_by(reason, no) FILTER (score > before) AS reason FROM running GROUP BY 1, 2) s USING (repo_id, path)",
    "imp": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS rank FROM scored WHERE score >= 50) WHERE rank <= 12",
    # --- relations
    "src": f"SELECT repo_id, path AS source, extension, content FROM paths WHERE {no_dirs('parts', 'relations')} "
           f"AND extension IN {in_list(vocab.SOURCE_EXTENSIONS)} AND length(content) > 0",
    # What begins on a line: the matches in it and the next lines, less those that the next lines have without it.
    "src_rows": "SELECT repo_id, source, extension, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS line, unnest(list_transform(range(1, len(ls) + 1), "
                "lambda i: array_to_string(ls[i:i + 11], chr(10)))) AS here, unnest(list_transform(range(1, len(ls) + 1), lambda i: array_to_string(ls[i + 1:i + 11], chr(10)))) AS later "
                "FROM (SELECT *, string_split(replace(content, chr(12), ' '), chr(10)) AS ls FROM src)",
    "src_lines": "SELECT * FROM src_rows WHERE regexp_matches(t, '(?i)import|require|axios|fetch|app|router|requests|httpx|@|path|url|session|metadata')",
    **{f"edges{e}": edge_sql(e) for e in relations.EXTRACTORS},
    "edges_all": " UNION ALL ".join(f"SELECT * FROM edges{e}" for e in relations.EXTRACTORS),
    "edges": "SELECT * FROM edges_all QUALIFY row_number() OVER (PARTITION BY repo_id, source, relationship, target ORDER BY extractor, line, pos) = 1",
    "apis": "SELECT repo_id, target FROM (SELECT DISTINCT repo_id, target FROM edges WHERE relationship = 'calls_api' AND "
            "regexp_matches(target, '^(https?://|/api/)')) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY target) <= 50",
    # --- technology
    "man": f"SELECT p.repo_id, v.kind, p.path, p.content FROM paths p JOIN {values(MANIFEST_NAMES)} v(name, kind, rnk) ON p.name = v.name "
           f"WHERE {no_dirs('p.parts', 'manifests')} QUALIFY row_number() OVER (PARTITION BY p.repo_id, v.kind ORDER BY v.rnk, p.depth, p.path) = 1",
    "npm_raw": "SELECT repo_id, sec.no AS sec, u.k AS dep, json_extract_string(content, '$.' || sec.name || '.\"' || u.k || '\"') AS version, u.i AS i FROM "
               "(SELECT * FROM man WHERE kind = 'npm' AND json_valid(content)) m, "
               "(VALUES (1, 'dependencies'), (2, 'devDependencies'), (3, 'peerDependencies')) sec(no, name), "
               "LATERAL (SELECT unnest(json_keys(m.content, '$.' || sec.name)) AS k, unnest(range(1, len(json_keys(m.content, '$.' || sec.name)) + 1)) AS i) u",
    "npm": "SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY first_at) AS ord, dep, version FROM (SELECT repo_id, dep, "
           "min(sec * 100000 + i) AS first_at, max_by(version, sec) AS version FROM npm_raw GROUP BY 1, 2)",
    "pip_raw": f"SELECT repo_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT repo_id, "
               f"regexp_split_to_array(content, {q(text.LINE_END)}) AS ls FROM man WHERE kind = 'pip')",
    "pip": f"SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY i) AS ord, dep FROM (SELECT repo_id, dep, min(i) AS i FROM ("
           f"SELECT repo_id, i, lower({strip('regexp_split_to_array(s, ' + q(tech.VERSION_MARK) + ')[1]')}) AS dep FROM ("
           f"SELECT repo_id, i, {strip('l')} AS s FROM pip_raw) WHERE s <> '' AND NOT starts_with(s, '#')) WHERE dep <> '' GROUP BY 1, 2)",
    # The fixture has one poetry key and one dependency list per document.
    "pyp": "SELECT repo_id, unnest(range(1, len(d) + 1)) AS ord, unnest(d) AS dep FROM (SELECT repo_id, "
           "regexp_extract_all(content, '(?m)^(\\w+) = \"', 1) || list_transform(string_split(regexp_extract(content, 'dependencies = \\[([^\\]]*)\\]', 1), ','), "
           "lambda x: regexp_replace(trim(x, ' \"'), '[=<>!~\\[;].*', '')) AS d FROM man WHERE kind = 'pyproject')",
    "maven": f"SELECT a.repo_id, v.facet, v.label, min(a.no * 1000 + v.pos) AS pos FROM (SELECT repo_id, unnest(x) AS artifact, unnest(range(0, len(x))) AS no "
             f"FROM (SELECT repo_id, regexp_extract_all(content, {q(tech.ARTIFACT)}, 1) AS x FROM man WHERE kind = 'maven')) a "
             f"JOIN {values(TEXT_VOCAB)} v(facet, k, label, pos) ON contains(lower(a.artifact), v.k) GROUP BY 1, 2, 3",
    "gradle": f"SELECT m.repo_id, v.facet, v.label, min(v.pos) AS pos FROM man m JOIN {values(TEXT_VOCAB)} v(facet, k, label, pos) "
              f"ON contains(lower(m.content), v.k) WHERE m.kind = 'gradle' GROUP BY 1, 2, 3",
    "images": f"SELECT repo_id, unnest(x) AS image, unnest(range(1, len(x) + 1)) AS no FROM (SELECT repo_id, "
              f"regexp_extract_all(content, {q(tech.IMAGE)}, 1) AS x FROM man WHERE kind = 'compose')",
    "image_dbs": f"SELECT i.repo_id, v.label, min((i.no - 1) * 1000 + v.pos) AS first_at FROM images i JOIN {values([t for t in TEXT_VOCAB if t[0] == 'databases'])} "
                 f"v(facet, k, label, pos) ON contains(split_part(lower(i.image), ':', 1), v.k) GROUP BY 1, 2",
    "words": f"SELECT DISTINCT repo_id, v.label, o.pos FROM (SELECT DISTINCT repo_id, lower(unnest(regexp_extract_all(content, {q(tech.AI_WORDS)}, 1))) AS w "
             f"FROM paths WHERE {no_dirs('parts', 'sources')} AND extension IN {in_list(vocab.SOURCE_EXTENSIONS)}) h "
             f"JOIN {values(vocab.AI_SOURCE_WORDS.items())} v(w, label) USING (w) JOIN {values(AI_ORDER.items())} o(label, pos) ON o.label = v.label",
    "langs": f"SELECT DISTINCT repo_id, v.l AS language FROM paths p JOIN {values(vocab.STACK_LANGUAGES.items())} v(k, l) ON p.extension = v.k "
             f"WHERE {no_dirs('p.parts', 'sources')}",
    "pms": f"SELECT repo_id, v.label, min(v.pos) AS pos FROM paths p JOIN {values([(n, l, i) for i, (n, l) in enumerate(vocab.PACKAGE_MANAGERS.items())])} "
           f"v(k, label, pos) ON p.path = v.k GROUP BY 1, 2",
    "docker": "SELECT DISTINCT repo_id FROM man WHERE kind IN ('docker', 'compose')",
    "facts_all": " UNION ALL ".join([
        f"SELECT repo_id, 'languages' AS facet, language AS label, 0 AS src, 0 AS pos FROM langs",
        f"SELECT repo_id, 'languages', v.l, v.src, 0 FROM man m JOIN {values([(k, l, RANK[k]) for k, l in vocab.MANIFEST_LANGUAGES.items()])} v(kind, l, src) ON m.kind = v.kind",
        f"SELECT DISTINCT repo_id, 'languages', 'TypeScript', {RANK['npm']}, 1 FROM npm WHERE dep = 'typescript' OR dep LIKE '@types/%'",
        dep_facts("npm", RANK["npm"]), dep_facts("pip", RANK["pip"]), dep_facts("pyp", RANK["pyproject"]),
        f"SELECT repo_id, facet, label, {RANK['maven']}, pos FROM maven",
        f"SELECT repo_id, facet, label, {RANK['gradle']}, pos FROM gradle",
        f"SELECT repo_id, 'databases', label, {RANK['compose']}, first_at FROM image_dbs",
        f"SELECT repo_id, 'ai_llm_libraries', label, {RANK['words']}, pos FROM words",
        f"SELECT repo_id, 'package_managers', label, 0, pos FROM pms",
        f"SELECT repo_id, 'docker', 'yes', {RANK['compose']}, 0 FROM docker"]),
    "facts": "SELECT repo_id, facet, label, min(src) AS src, min(pos) AS pos FROM (SELECT *, min(src) OVER (PARTITION BY repo_id, facet, label) AS ms FROM facts_all) WHERE src = ms GROUP BY 1, 2, 3",
    "stack_long": "SELECT repo_id, facet, string_agg(label, '|' ORDER BY src, pos, label) AS labels FROM facts WHERE facet <> 'docker' GROUP BY 1, 2 "
                  "UNION ALL SELECT repo_id, 'external_apis_detected', string_agg(target, '|' ORDER BY target) FROM apis GROUP BY 1",
    "repos": "SELECT DISTINCT repo_id FROM files",
    # --- secrets
    "findings": "SELECT * FROM (SELECT repo_id, path AS file, list_filter(["
                + ", ".join(f"CASE WHEN regexp_matches(content, {q(r.pattern)}) THEN {q(r.name)} END" for r in secrets.RULES)
                + "], lambda x: x IS NOT NULL) AS types FROM files) WHERE len(types) > 0",
}


def compose(sql: str, changed: dict[str, str] | None = None) -> str:
    """Prefixes the CTEs a statement needs, directly or through others; ``changed`` has others in place of some."""
    ctes = CTES | (changed or {})
    needed, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'(?:[^']|'')*'", "''", todo.pop())))
        for name in words & ctes.keys() - needed:
            needed.add(name)
            todo.append(ctes[name])
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in ctes if n in needed) + "\n" + sql


def _edges(e: int) -> str:
    return f"SELECT repo_id, source, relationship, target, evidence, CAST(line AS BIGINT) AS line, CAST(pos AS BIGINT) AS pos FROM edges{e}"


HIGH = arr([r.name for r in secrets.RULES if r.high_risk])

QUERIES: dict[str, str] = {
    "files_from_table": "SELECT repo_id, path, content, CAST(strlen(content) AS BIGINT) AS size FROM files",
    "path_parts": "SELECT repo_id, path, name, stem, extension, array_to_string(dirs, '|') AS dirs, CAST(depth AS BIGINT) AS depth, top_dir FROM paths",
    **{f"skip_dirs_{p}": f"SELECT repo_id, path FROM paths WHERE {no_dirs('dirs' if p == 'inventory' else 'parts', p)}" for p in vocab.SKIP_DIRS},
    "source_files": f"SELECT repo_id, path, CAST(strlen(content) AS BIGINT) AS size FROM paths WHERE extension IN {in_list(vocab.SOURCE_EXTENSIONS)} AND length(content) > 0",
    "strip_repo_root": f"""SELECT f.repo_id, CASE WHEN r.lo IS NOT NULL THEN substring(path, length(r.lo) + 2) ELSE path END AS path, content
        FROM files f LEFT JOIN (SELECT repo_id, min(t) AS lo FROM (SELECT repo_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS t
          FROM files WHERE split_part(path, '/', 1) NOT IN {in_list(vocab.SKIP_DIRS['inventory'])}) GROUP BY 1 HAVING count(DISTINCT t) = 1 AND min(t) <> '') r
        USING (repo_id) WHERE r.lo IS NULL OR starts_with(path, r.lo || '/')""",
    "safe_paths": """SELECT repo_id, substring(res, 2) AS path, given FROM (SELECT repo_id, given, list_reduce(list_prepend('', list_filter(string_split(replace(given, chr(92), '/'), '/'),
          lambda x: x <> '' AND x <> '.')), lambda a, x: CASE WHEN a = '!' THEN '!' WHEN x <> '..' THEN a || '/' || x WHEN a = '' THEN '!'
          ELSE regexp_replace(a, '/[^/]*$', '') END) AS res FROM
          (SELECT repo_id, concat(CASE length(path) % 7 WHEN 0 THEN '../' WHEN 1 THEN 'a/../' WHEN 2 THEN './/' WHEN 3 THEN '/' WHEN 4 THEN 'a/../../b/' WHEN 5 THEN concat('w', chr(92)) ELSE '' END, path) AS given FROM files)
          WHERE NOT starts_with(replace(given, chr(92), '/'), '/')) WHERE res NOT IN ('!', '')""",
    "with_language": "SELECT repo_id, path, language FROM lang",
    "with_category": "SELECT repo_id, path, category FROM cat",
    "inventory": "SELECT repo_id, path, extension, language, size, category, TRUE AS included FROM inv",
    "directory_summary": """SELECT repo_id, CAST(rank AS BIGINT) AS rank, top_dir, CAST(files AS BIGINT) AS n_files, languages FROM (
        SELECT d.repo_id, d.top_dir, d.n AS files, l.languages, row_number() OVER (PARTITION BY d.repo_id ORDER BY d.top_dir) AS rank
        FROM (SELECT repo_id, coalesce(top_dir, '(root)') AS top_dir, count(*) AS n FROM inv GROUP BY 1, 2) d
        JOIN (SELECT repo_id, top_dir, string_agg(language, '|' ORDER BY fp, language) AS languages FROM (SELECT repo_id, coalesce(top_dir, '(root)') AS top_dir, language,
          min(path) AS fp FROM inv GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY repo_id, coalesce(top_dir, '(root)') ORDER BY min(path), language) <= 5) GROUP BY 1, 2) l
        USING (repo_id, top_dir)) WHERE rank <= 20""",
    "file_counts": "SELECT repo_id, count(*) AS n_files FROM inv GROUP BY 1",
    "score_files": "SELECT repo_id, path, score, reason_important FROM scored",
    "important_files": "SELECT repo_id, CAST(rank AS BIGINT) AS rank, path, reason_important, score, language, category FROM imp",
    # --- relations
    "js_imports": _edges(1), "js_dynamic_imports": _edges(2), "js_http_calls": _edges(3), "js_routes": _edges(4),
    "py_imports": _edges(5), "py_requests_calls": _edges(6), "py_httpx_calls": _edges(7), "py_decorator_routes": _edges(8),
    "flask_routes": _edges(9), "django_urls": _edges(10), "orm_usage": _edges(11),
    "dedupe_relationships": "SELECT repo_id, source, relationship, target, evidence FROM edges",
    "relationships": "SELECT repo_id, source, relationship, target, evidence, CAST(extractor AS BIGINT) AS extractor, CAST(line AS BIGINT) AS line, CAST(pos AS BIGINT) AS pos FROM edges",
    "evidence": "SELECT DISTINCT repo_id, source, evidence FROM edges",
    **{f"relationships_of_{k}": f"SELECT repo_id, CAST(rank AS BIGINT) AS rank, source, target, evidence FROM (SELECT *, row_number() OVER (PARTITION BY repo_id "
                                f"ORDER BY string_split(source, '/'), extractor, line, pos, target) AS rank FROM edges WHERE relationship = '{k}') WHERE rank <= {n}"
       for k, n in (("imports", 30), ("declares_route", 30), ("calls_api", 20), ("uses_model", 20))},
    "external_apis": "SELECT repo_id, target FROM apis",
    # --- technology
    "find_manifest": "SELECT repo_id, kind, path, md5(content) AS digest FROM man",
    "npm_dependencies": "SELECT repo_id, ord, dep, version FROM npm",
    "pip_dependencies": "SELECT repo_id, ord, dep FROM pip",
    "pyproject_dependencies": "SELECT repo_id, ord, dep FROM pyp",
    "maven_labels": "SELECT repo_id, facet, label, pos FROM maven",
    "gradle_labels": "SELECT repo_id, facet, label, CAST(pos AS BIGINT) AS pos FROM gradle",
    "container_facts": """SELECT d.repo_id, TRUE AS docker, coalesce(i.images, '') AS images, coalesce(b.databases, '') AS databases FROM docker d
        LEFT JOIN (SELECT repo_id, string_agg(image, '|' ORDER BY no) AS images FROM images WHERE no <= 20 GROUP BY 1) i USING (repo_id)
        LEFT JOIN (SELECT repo_id, string_agg(label, '|' ORDER BY first_at) AS databases FROM image_dbs GROUP BY 1) b USING (repo_id)""",
    "match_dependencies": "SELECT repo_id, facet, label, min(pos) AS ord FROM (" + dep_facts("npm", 1) + ") GROUP BY 1, 2, 3",
    "ai_source_hits": "SELECT repo_id, label, CAST(pos AS BIGINT) AS pos FROM words",
    "languages_by_extension": "SELECT repo_id, language FROM langs",
    "package_managers": "SELECT repo_id, label, CAST(pos AS BIGINT) AS pos FROM pms",
    "tech_facts": "SELECT repo_id, facet, label, CAST(src AS BIGINT) AS src, CAST(pos AS BIGINT) AS pos FROM facts",
    "tech_stack": "SELECT r.repo_id, " + ", ".join(
        f"coalesce(max(CASE WHEN facet = '{f}' THEN labels END), '') AS {f}" for f in [*vocab.FACETS, "external_apis_detected"])
        + ", r.repo_id IN (SELECT repo_id FROM docker) AS docker FROM repos r LEFT JOIN stack_long s USING (repo_id) GROUP BY r.repo_id",
    "tech_summary": "SELECT repo_id, facet, labels FROM stack_long",
    # --- secrets
    "scan_secrets": "SELECT repo_id, file, array_to_string(types, '|') AS secret_types FROM findings",
    "mask_secrets": f"SELECT f.repo_id, f.path, md5(f.masked) AS masked_digest, coalesce(array_to_string(x.types, '|'), '') AS secret_types "
                    f"FROM ({masked_sql('files', 'repo_id, path', 'content')}) f LEFT JOIN findings x ON f.repo_id = x.repo_id AND f.path = x.file",
    "secrets_report": f"""SELECT r.repo_id, r.n AS total_files_scanned, coalesce(s.n, 0) AS files_with_secrets, coalesce(t.names, '') AS secret_types_found,
        coalesce(s.high, 0) AS high_risk_count, coalesce(x.first10, '') AS findings
        FROM (SELECT repo_id, count(*) AS n FROM files GROUP BY 1) r
        LEFT JOIN (SELECT repo_id, count(*) AS n, count(*) FILTER (list_has_any(types, {HIGH})) AS high FROM findings GROUP BY 1) s USING (repo_id)
        LEFT JOIN (SELECT repo_id, string_agg(name, '|' ORDER BY no) AS names FROM (SELECT DISTINCT repo_id, unnest(types) AS name FROM findings)
          JOIN {values([(r.name, i) for i, r in enumerate(secrets.RULES)])} v(name, no) USING (name) GROUP BY 1) t USING (repo_id)
        LEFT JOIN (SELECT repo_id, string_agg(file || ':' || array_to_string(types, '+'), '|' ORDER BY file) AS first10 FROM (SELECT * FROM findings
          QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file) <= 10) GROUP BY 1) x USING (repo_id)""",
    "high_risk_files": f"SELECT repo_id, file FROM findings WHERE list_has_any(types, {HIGH})",
    # --- status
    "latest_status": "SELECT project_id, max_by(status, ts) AS status, max_by(event_id, ts) AS event_id FROM status_log GROUP BY 1",
    "status_view": f"""SELECT l.project_id, l.status, coalesce(v.stage, l.status) AS stage, CAST(coalesce(v.progress, 0) AS BIGINT) AS progress,
        l.status IN {in_list(vocab.COMPLETE_STATUSES)} AS is_complete, l.status = 'error' AS is_error,
        l.status IN {in_list(vocab.GENERATE_STATUSES)} AS can_generate, l.status = 'complete' AS results_ready
        FROM (SELECT project_id, max_by(status, ts) AS status FROM status_log GROUP BY 1) l
        LEFT JOIN {values([(k, s, p) for k, (s, p) in vocab.STATUS_STAGES.items()])} v(status, stage, progress) USING (status)""",
}


# --- generated sections, graphs, validation, prompts -------------------------------------------

from codecairn.operators import graphs, prompts, validate  # noqa: E402

NL = "chr(10)"
BS = "chr(92)"


def lit(s: str) -> str:
    """A string literal with its newlines as chr(10)."""
    return "(" + " || chr(10) || ".join(q(x) for x in s.split("\n")) + ")"


def participant_sql(col: str) -> str:
    whens = " ".join(f"WHEN {has_word(f'lower({col})', ws)} THEN '{n}'" for n, ws in vocab.PARTICIPANT_CLASSES.items())
    return f"CASE {whens} ELSE '{vocab.DEFAULT_PARTICIPANT}' END"


def style_text(level: str) -> str:
    c = vocab.LEVELS[level]
    return "\n".join(["## Audience & Writing Style", "- **Tone**: " + c["tone"], "- **Depth**: " + c["max_technical_depth"]]
                     + [vocab.STYLE_LINES[k][0 if c[k] else 1] for k in vocab.STYLE_LINES])


def cap(col: str, n: int = 10000, note: str = vocab.PROMPT_NOTE) -> str:
    return f"CASE WHEN length({col}) > {n} THEN substring({col}, 1, {n}) || {lit(note)} ELSE {col} END"


def tech_text(bullet: str, close: str, cut: int | None) -> str:
    keys = [*vocab.FACETS[:7], "docker", *vocab.FACETS[7:], "external_apis_detected"]
    parts = []
    for k in keys:
        if k == "docker":
            parts.append(f"CASE WHEN docker THEN {q(bullet + k + close + ': yes')} END")
        else:
            lst = f"string_split({k}, '|')" + (f"[1:{cut}]" if cut else "")
            parts.append(f"CASE WHEN {k} <> '' THEN {q(bullet + k + close + ': ')} || array_to_string({lst}, ', ') END")
    return f"concat_ws(chr(10), {', '.join(parts)})"


def rel_lines(where: str, n: int, line: str, rank: str = "rk") -> str:
    return f"string_agg({line}, chr(10) ORDER BY rk) FILTER ({where} AND {rank} <= {n})"


_LINE = "'• [' || relationship || '] ' || source || ' → ' || target || '  (evidence: ' || substring(evidence, 1, 80) || ')'"


_SHORT = "'• ' || source || ': ' || target"


def ends(default: str, x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN {x} ELSE {q(default)} END"


def sums(n: int) -> str:
    return f"coalesce((SELECT string_agg(sline, {NL} || {NL} ORDER BY rank) FROM sum_lines s WHERE s.repo_id = c.repo_id AND s.rank <= {n}), '')"


def rels(where: str, n: int) -> str:
    return ends("No relationships detected.", f"(SELECT string_agg({_LINE}, {NL} ORDER BY rk) FROM ranked_edges e WHERE e.repo_id = c.repo_id AND {where} <= {n})")


def kind(k: str) -> str:
    return f"relationship = '{k}' AND kr"


TYPES_FOUND = "replace(secret_types_found, '|', ', ')"
NL2 = f"{NL} || {NL}"

CTES |= {
    "stack": QUERIES["tech_stack"],
    "flow_docs": f"SELECT repo_id, run_id, string_agg(markdown, {NL} ORDER BY section) AS markdown FROM sections GROUP BY 1, 2",
    "flow_lines": f"SELECT repo_id, run_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(markdown, {NL}) AS ls FROM flow_docs)",
    "flow_events": f"""SELECT *, lag(num) OVER w AS prev_num, lag(action) OVER w AS prev_action FROM (SELECT repo_id, run_id, i,
        CASE WHEN regexp_matches(l, {q(graphs.STEP)}) THEN regexp_extract(l, {q(graphs.STEP)}, 1) END AS num,
        {strip(f"regexp_replace(regexp_extract(l, {q(graphs.STEP)}, 2), {q(graphs.STEP_NOISE)}, '', 'g')")} AS action,
        CASE WHEN regexp_matches(l, {q(graphs.STEP_FILE)}) THEN regexp_extract(l, {q(graphs.STEP_FILE)}, 1) END AS file FROM flow_lines)
        WHERE num IS NOT NULL OR file IS NOT NULL WINDOW w AS (PARTITION BY repo_id, run_id ORDER BY i)""",
    "steps": f"""SELECT repo_id, run_id, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY i) AS step_no, prev_num AS num, prev_action AS action, file,
        {participant_sql('file')} AS participant FROM flow_events WHERE num IS NULL AND prev_num IS NOT NULL""",
    "flow_nodes": """SELECT repo_id, run_id, 'main_user_flow.mmd' AS diagram, p AS node_id, p AS label, CASE WHEN p = 'User' THEN 'actor' ELSE 'participant' END AS shape,
        row_number() OVER (PARTITION BY repo_id, run_id ORDER BY at0) - 1 AS pos FROM (
          SELECT repo_id, run_id, participant AS p, min(step_no) AS at0 FROM steps GROUP BY 1, 2, 3
          UNION ALL SELECT DISTINCT repo_id, run_id, 'User', 0 FROM steps
          UNION ALL SELECT f.repo_id, f.run_id, v.p, v.i FROM flow_docs f ANTI JOIN steps s ON f.repo_id = s.repo_id AND f.run_id = s.run_id,
            (VALUES ('User', 0), ('Frontend', 1), ('Backend', 2), ('Database', 3)) v(p, i))""",
    "flow_edges": f"""SELECT repo_id, run_id, 'main_user_flow.mmd' AS diagram, source, target, arrow, label, pos FROM (
        SELECT repo_id, run_id, coalesce(lag(participant) OVER (PARTITION BY repo_id, run_id ORDER BY step_no), 'User') AS source, participant AS target, '->>' AS arrow,
          CASE WHEN length('Step ' || num || ': ' || action) > 40 THEN substring('Step ' || num || ': ' || action, 1, 37) || '...' ELSE 'Step ' || num || ': ' || action END AS label, step_no + 9 AS pos FROM steps
        UNION ALL SELECT repo_id, run_id, max_by(participant, step_no), 'User', '-->>', 'Completed Flow', max(step_no) + 10 FROM steps GROUP BY 1, 2
        UNION ALL SELECT f.repo_id, f.run_id, v.a, v.b, v.arrow, v.t, v.i FROM flow_docs f ANTI JOIN steps s ON f.repo_id = s.repo_id AND f.run_id = s.run_id,
          {values([(*x, 10 + i) for i, x in enumerate(vocab.DEFAULT_FLOW)])} v(a, b, arrow, t, i))""",
    "hosts": "SELECT repo_id, string_agg(h, ', ' ORDER BY h) AS hs FROM (SELECT DISTINCT repo_id, regexp_replace(regexp_extract(target, '.*//(.*)$', 1), '/.*', '') AS h FROM apis "
             "WHERE contains(target, '//') QUALIFY dense_rank() OVER (PARTITION BY repo_id ORDER BY h) <= 3) GROUP BY 1",
    "arch_nodes": f"""SELECT s.repo_id, 'system_architecture.mmd' AS diagram, v.id AS node_id, v.label, v.shape, v.pos FROM stack s LEFT JOIN hosts h USING (repo_id),
        LATERAL (SELECT unnest(['User', 'Frontend', 'Backend', 'Database', 'AIService', 'ExtAPI', 'Container']) AS id, unnest(['User',
          CASE WHEN frontend_frameworks = '' THEN 'Frontend' ELSE 'Frontend' || {BS} || 'n(' || replace(frontend_frameworks, '|', ', ') || ')' END,
          CASE WHEN backend_frameworks = '' THEN 'Backend' ELSE 'Backend' || {BS} || 'n(' || replace(backend_frameworks, '|', ', ') || ')' END,
          CASE WHEN databases = '' THEN 'Database' ELSE 'Database' || {BS} || 'n(' || replace(databases, '|', ', ') || ')' END,
          CASE WHEN ai_llm_libraries <> '' THEN 'AI / LLM Services' || {BS} || 'n(' || replace(ai_llm_libraries, '|', ', ') || ')' END,
          CASE WHEN external_apis_detected <> '' THEN 'External Services' || {BS} || 'n(' || coalesce(h.hs, 'External APIs') || ')' END,
          CASE WHEN docker THEN 'Containerized with Docker' END]) AS label,
          unnest(['round', 'box', 'box', 'store', 'box', 'box', 'note']) AS shape, unnest([0, 1, 2, 3, 7, 9, 11]) AS pos) v WHERE v.label IS NOT NULL""",
    "arch_edges": """SELECT repo_id, 'system_architecture.mmd' AS diagram, v.a AS source, v.b AS target, '-->' AS arrow, CAST(NULL AS VARCHAR) AS label, v.pos FROM stack,
        (VALUES ('User', 'Frontend', 4), ('Frontend', 'Backend', 5), ('Backend', 'Database', 6), ('Backend', 'AIService', 8), ('Backend', 'ExtAPI', 10)) v(a, b, pos)
        WHERE (v.b <> 'AIService' OR ai_llm_libraries <> '') AND (v.b <> 'ExtAPI' OR external_apis_detected <> '')""",
    "folders": """SELECT repo_id, folder, row_number() OVER (PARTITION BY repo_id ORDER BY folder) AS rank FROM (
        SELECT DISTINCT repo_id, parts[1] AS folder FROM inv WHERE depth > 1 UNION SELECT DISTINCT repo_id, parts[1] || '/' || parts[2] FROM inv WHERE depth > 2)
        QUALIFY rank <= 25""",
    "map_nodes": """SELECT DISTINCT repo_id, 'repository_map.mmd' AS diagram, 'root' AS node_id, 'Repository Root' AS label, 'box' AS shape, 0 AS pos FROM inv
        UNION ALL SELECT repo_id, 'repository_map.mmd', translate(folder, '/.-', '___'), '📁 ' || regexp_extract(folder, '[^/]*$'), 'box', 2 * rank - 1 FROM folders""",
    "map_edges": """SELECT repo_id, 'repository_map.mmd' AS diagram, CASE WHEN contains(folder, '/') THEN translate(split_part(folder, '/', 1), '/.-', '___') ELSE 'root' END AS source,
        translate(folder, '/.-', '___') AS target, '-->' AS arrow, CAST(NULL AS VARCHAR) AS label, 2 * rank AS pos FROM folders""",
    "model_files": f"SELECT repo_id, content FROM imp WHERE {has_word('lower(path)', graphs.MODEL_PATHS)}",
    "entity_all": "SELECT DISTINCT repo_id, unnest(" + " || ".join(f"regexp_extract_all(content, {q(p)}, 1)" for p in graphs.ENTITY_PATTERNS) + ") AS name FROM model_files",
    "entities": """SELECT repo_id, name, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS rank FROM entity_all QUALIFY rank <= 10
        UNION ALL SELECT m.repo_id, v.name, v.rank FROM (SELECT DISTINCT repo_id FROM model_files) m ANTI JOIN entity_all e ON m.repo_id = e.repo_id, (VALUES ('User', 1), ('Session', 2)) v(name, rank)""",
    "ent_nodes": "SELECT repo_id, 'database_erd.mmd' AS diagram, name AS node_id, name AS label, 'entity' AS shape, rank AS pos FROM entities",
    "ent_edges": "SELECT repo_id, 'database_erd.mmd' AS diagram, name AS source, nxt AS target, '||--o{' AS arrow, 'relates' AS label, rank + 10 AS pos FROM "
                 "(SELECT *, lead(name) OVER (PARTITION BY repo_id ORDER BY rank) AS nxt FROM entities) WHERE nxt IS NOT NULL",
    "dia_lines": f"""SELECT repo_id, diagram, pos, CASE shape WHEN 'round' THEN '    ' || node_id || '([' || label || '])' WHEN 'store' THEN '    ' || node_id || '[(" ' || label || ' ")]'
          WHEN 'note' THEN '    %% ' || label WHEN 'entity' THEN '    ' || node_id || ' {{' || {NL} || '        string id PK' || {NL} || '        string name' || {NL} || '    }}'
          ELSE '    ' || node_id || '["' || label || '"]' END AS line FROM (SELECT * FROM arch_nodes UNION ALL SELECT * FROM map_nodes UNION ALL SELECT * FROM ent_nodes)
        UNION ALL SELECT repo_id, diagram, pos, '    ' || source || ' ' || arrow || ' ' || target || CASE WHEN label IS NULL THEN '' ELSE ' : ' || label END
          FROM (SELECT * FROM arch_edges UNION ALL SELECT * FROM map_edges UNION ALL SELECT * FROM ent_edges)""",
    "diagrams": f"SELECT repo_id, diagram, CASE WHEN diagram = 'database_erd.mmd' THEN 'erDiagram' ELSE 'flowchart TD' END || {NL} || string_agg(line, {NL} ORDER BY pos) AS text FROM dia_lines GROUP BY 1, 2",
    "flow_text": f"""SELECT repo_id, run_id, 'main_user_flow.mmd' AS diagram, 'sequenceDiagram' || {NL} || string_agg(line, {NL} ORDER BY k, pos) AS text FROM (
        SELECT repo_id, run_id, 0 AS k, pos, '    ' || shape || ' ' || node_id AS line FROM flow_nodes
        UNION ALL SELECT repo_id, run_id, 1, pos, '    ' || source || arrow || target || ': ' || label FROM flow_edges) GROUP BY 1, 2""",
    "mentions": f"SELECT DISTINCT repo_id, run_id, section, p AS path FROM (SELECT repo_id, run_id, section, unnest(regexp_extract_all(markdown, {q(validate.PATH_TOKEN)}, 0)) AS p FROM sections) "
                "WHERE NOT starts_with(p, 'http') AND NOT starts_with(p, 'www.') AND NOT regexp_full_match(p, '[0-9]+[.][0-9]+')",
    "bad_paths": "SELECT m.* FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM inv i WHERE i.repo_id = m.repo_id AND (i.path = m.path OR i.name = regexp_extract(m.path, '[^/]*$')))",
    "drawn": "SELECT x.repo_id, x.run_id, g.diagram, g.text FROM (SELECT DISTINCT repo_id, run_id FROM sections) x JOIN diagrams g USING (repo_id) "
             "UNION ALL SELECT repo_id, run_id, diagram, text FROM flow_text",
    "labels0": f"""SELECT DISTINCT repo_id, run_id, diagram, label FROM (
        SELECT repo_id, run_id, diagram, {strip("CASE WHEN regexp_full_match(m, '" + validate.QUOTED_BOX[1:-1] + "') THEN m[3:-3] ELSE m[2:-2] END")} AS label FROM (
          SELECT repo_id, run_id, diagram, unnest(regexp_extract_all(text, {q(validate.BRACKETED)}, 0)) AS m FROM drawn)
        UNION ALL SELECT repo_id, run_id, diagram, unnest(regexp_extract_all(text, {q(validate.ACTOR)}, 1)) FROM drawn)""",
    "known": "SELECT DISTINCT repo_id, lower(c) AS c FROM (SELECT repo_id, path AS c FROM imp UNION ALL SELECT repo_id, regexp_extract(path, '[^/]*$') FROM imp "
             "UNION ALL SELECT repo_id, source FROM edges UNION ALL SELECT repo_id, target FROM edges)",
    "bad_parts": f"SELECT l.repo_id, l.run_id, l.diagram, l.label AS component FROM labels0 l WHERE lower(l.label) NOT IN {in_list(vocab.GENERIC_COMPONENTS)} "
                 "AND NOT EXISTS (SELECT 1 FROM known k WHERE k.repo_id = l.repo_id AND (contains(k.c, lower(l.label)) OR contains(lower(l.label), k.c)))",
    "sec_types": "SELECT repo_id, run_id, section, list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(markdown, {q(r.pattern)}) THEN {q(r.name)} END" for r in secrets.RULES) + "], lambda x: x IS NOT NULL) AS types FROM sections",
    "masked": f"SELECT repo_id, run_id, section, masked AS markdown FROM ({masked_sql('sections', 'repo_id, run_id, section', 'markdown')})",
    "report": """SELECT r.repo_id, r.run_id, coalesce(p.t, '') AS unresolved_file_paths, coalesce(d.t, '') AS unresolved_diagram_components, coalesce(l.t, '') AS leaked_secrets_detected, coalesce(p.n, 0) AS n
        FROM (SELECT DISTINCT repo_id, run_id FROM sections) r
        LEFT JOIN (SELECT repo_id, run_id, count(*) AS n, string_agg(section || '.md:' || path, '|' ORDER BY section, path) AS t FROM bad_paths GROUP BY 1, 2) p USING (repo_id, run_id)
        LEFT JOIN (SELECT repo_id, run_id, string_agg(section || '.md:' || array_to_string(types, '+'), '|' ORDER BY section) AS t FROM sec_types WHERE len(types) > 0 GROUP BY 1, 2) l USING (repo_id, run_id)
        LEFT JOIN (SELECT repo_id, run_id, string_agg(diagram || ':' || component, '|' ORDER BY diagram, component) AS t FROM bad_parts GROUP BY 1, 2) d USING (repo_id, run_id)""",
    "answers": f"SELECT repo_id, path, rank, {fixtures.ANSWER_SQL} AS answer FROM imp",
    "summaries": """SELECT repo_id, path, rank, CASE WHEN ok THEN json_extract_string(j, '$.responsibility') ELSE substring(trim(answer), 1, 500) END AS responsibility,
        CASE WHEN ok THEN CAST(json_extract(j, '$.important_symbols') AS VARCHAR[]) ELSE [] END AS syms, CASE WHEN ok THEN json_extract_string(j, '$.inputs') ELSE '' END AS inputs,
        CASE WHEN ok THEN json_extract_string(j, '$.outputs') ELSE '' END AS outputs, CASE WHEN ok THEN CAST(json_extract(j, '$.connections') AS VARCHAR[]) ELSE [] END AS conns,
        CASE WHEN ok THEN json_extract_string(j, '$.evidence_snippet') ELSE '' END AS snippet
        FROM (SELECT *, json_valid(answer) AS ok, CASE WHEN json_valid(answer) THEN answer ELSE '{}' END AS j FROM answers)""",
    "sum_lines": f"""SELECT repo_id, rank, '• ' || path || {NL} || '  Responsibility: ' || responsibility || {NL} || '  Symbols: ' || {ends('none', "array_to_string(syms[1:5], ', ')")}
          || ' | Connects to: ' || {ends('none', "array_to_string(conns[1:4], ', ')")} AS pline,
        '### ' || path || {NL} || '**Responsibility**: ' || responsibility || {NL} || '**Inputs**: ' || inputs || ' | **Outputs**: ' || outputs || {NL} || '**Symbols**: '
          || {ends('none', "array_to_string(syms[1:6], ', ')")} || ' | **Connects to**: ' || {ends('none', "array_to_string(conns[1:4], ', ')")} || {NL}
          || '**Snippet**: `' || substring(replace(snippet, {NL}, ' '), 1, 120) || '`' AS sline FROM summaries""",
    "ranked_edges": """SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY string_split(source, '/'), extractor, line, pos, target) AS rk,
        row_number() OVER (PARTITION BY repo_id, relationship ORDER BY string_split(source, '/'), extractor, line, pos, target) AS kr FROM edges""",
    "techt": f"SELECT repo_id, {ends('No tech data.', tech_text('- **', '**', 10))} AS tech_text, {tech_text('  ', '', None)} AS plan_tech_text FROM stack",
    "plans": f"""SELECT repo_id, CASE WHEN ok THEN CAST(json_extract(a, '$.major_modules') AS VARCHAR) ELSE '[]' END AS major_modules,
        CASE WHEN ok THEN CAST(json_extract(a, '$.explanation_order') AS VARCHAR) ELSE '[]' END AS explanation_order,
        CASE WHEN ok THEN json_extract_string(a, '$.main_user_flow_target') ELSE 'primary user flow' END AS main_user_flow_target,
        CASE WHEN ok THEN 'flow' ELSE 'architecture overview|data flow' END AS required_diagrams, '' AS concepts_needing_analogies,
        CASE WHEN ok THEN 'deployment' ELSE 'Plan generation failed: the answer is not valid JSON' END AS uncertain_areas, ok,
        CASE WHEN ok THEN '[' || array_to_string(list_transform(json_extract(a, '$.explanation_order[*]')[1:5], lambda x: CAST(x AS VARCHAR)), ',') || ']' ELSE '[]' END AS first5
        FROM (SELECT repo_id, CASE WHEN json_valid(ans) THEN ans END AS a, json_valid(ans) AS ok FROM (SELECT repo_id, {fixtures.PLAN_ANSWER_SQL} AS ans FROM projects))""",
    "setup_roots": f"""SELECT repo_id, coalesce(max(b) FILTER (path = 'README.md'), max(b) FILTER (path = 'readme.md')) AS readme, max(b) FILTER (path = 'package.json') AS package_json,
        max(b) FILTER (path = 'requirements.txt') AS requirements FROM (SELECT repo_id, path, {cap('content', 3000, vocab.SETUP_NOTE)} AS b FROM files
          WHERE path IN ('README.md', 'readme.md', 'package.json', 'requirements.txt') AND length(content) > 0) GROUP BY 1""",
    "dockerfiles": f"""SELECT repo_id, '--- ' || path || ' ---' || {NL} || {cap('content', 800, vocab.SETUP_NOTE)} AS d,
        row_number() OVER (PARTITION BY repo_id ORDER BY string_split(path, '/')) AS rank FROM paths WHERE contains(lname, 'dockerfile') AND length(content) > 0 QUALIFY rank <= 5""",
    "setup": f"""SELECT repo_id, readme, package_json, requirements, coalesce(ds, '') AS dockerfiles, cut FROM setup_roots FULL JOIN
        (SELECT repo_id, string_agg(d, {NL2} ORDER BY rank) AS ds, string_agg(substring(d, 1, 800), {NL2} || '---' || {NL2} ORDER BY rank) AS cut FROM dockerfiles GROUP BY 1) USING (repo_id)""",
    "risks": f"SELECT repo_id, string_agg(file, ', ' ORDER BY file) AS t FROM findings WHERE list_has_any(types, {HIGH}) GROUP BY 1",
    "srep": QUERIES["secrets_report"],
    "find10": "SELECT repo_id, '[' || string_agg('{\"file\":\"' || file || '\",\"secret_types\":[\"' || array_to_string(types, '\",\"') || '\"]}', ',' ORDER BY file) || ']' AS t FROM "
              "(SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY file) <= 10) GROUP BY 1",
    "dsum": QUERIES["directory_summary"],
    "ctx": """SELECT p.*, t.tech_text, l.major_modules, l.first5, l.main_user_flow_target, l.ok, s.readme, s.package_json, s.requirements, s.cut, r.total_files_scanned, r.files_with_secrets,
        r.secret_types_found, k.t AS risk, f.t AS finds FROM projects p LEFT JOIN techt t USING (repo_id) LEFT JOIN plans l USING (repo_id) LEFT JOIN setup s USING (repo_id)
        LEFT JOIN srep r USING (repo_id) LEFT JOIN risks k USING (repo_id) LEFT JOIN find10 f USING (repo_id)""",
}

_PROMPTS = {
    "01_start_here": f"'## Tech Stack' || {NL} || tech_text || {NL2} || '## Major Modules' || {NL} || major_modules || {NL2} || '## Suggested Reading Order (first 5 steps)' || {NL} || first5 || {NL2} "
                     f"|| '## Main User Flow This Tutorial Will Trace' || {NL} || main_user_flow_target",
    "02_product_overview": f"'## User-Provided Product Description' || {NL} || coalesce(product_description, '(none provided)') || {NL2} || '## Tech Stack (from repository)' || {NL} || tech_text || {NL2} "
                           f"|| '## Important File Summaries (from repository)' || {NL} || {sums(15)}",
    "03_tech_stack": f"'## Detected Tech Stack' || {NL} || tech_text || {NL2} || '## File Summaries for Context' || {NL} || {sums(10)}",
    "04_architecture": f"'## Tech Stack' || {NL} || tech_text || {NL2} || '## Declared Routes (' || (SELECT count(*) FROM edges e WHERE e.repo_id = c.repo_id AND relationship = 'declares_route') || ' total)' || {NL} || {rels(kind('declares_route'), 30)} "
                       f"|| {NL2} || '## Internal Imports (sample of ' || (SELECT least(count(*), 30) FROM edges e WHERE e.repo_id = c.repo_id AND relationship = 'imports') || ')' || {NL} || {rels(kind('imports'), 30)} "
                       f"|| {NL2} || '## External API Calls (' || (SELECT least(count(*), 20) FROM edges e WHERE e.repo_id = c.repo_id AND relationship = 'calls_api') || ' total)' || {NL} || {rels(kind('calls_api'), 20)} "
                       f"|| {NL2} || '## File Summaries' || {NL} || {sums(15)}",
    "05_component_guide": f"'## File Summaries' || {NL} || {sums(20)} || {NL2} || '## Relationships (sample)' || {NL} || {rels('rk', 40)}",
    "06_main_user_flow": f"'## User-Provided Key Features' || {NL} || coalesce(important_features, '(none provided — infer the main flow from the code)') || {NL2} || '## API Routes (potential flow entry points)' || {NL} "
                         f"|| {rels(kind('declares_route'), 30)} || {NL2} || '## File Summaries' || {NL} || {sums(15)} || {NL2} || '## Imports / Dependencies' || {NL} || {rels(kind('imports'), 25)}",
    "07_repo_guide": f"'## Top-Level Directory Summary' || {NL} || coalesce((SELECT string_agg('- **' || top_dir || '/**: ' || n_files || ' files, langs: ' || replace(languages, '|', ', '), {NL} ORDER BY rank) FROM dsum d WHERE d.repo_id = c.repo_id), '') "
                     f"|| {NL2} || '## Heuristically Important Files' || {NL} || coalesce((SELECT string_agg('- `' || path || '` — ' || reason_important || ' (score: ' || score || ')', {NL} ORDER BY rank) FROM imp i WHERE i.repo_id = c.repo_id), '') "
                     f"|| {NL2} || '## Total files in inventory: ' || (SELECT count(*) FROM inv i WHERE i.repo_id = c.repo_id)",
    "08_how_to_run": f"concat_ws({NL2}, coalesce('## README.md content (first 3000 chars)' || {NL} || substring(readme, 1, 3000), '## README.md' || {NL} || '(not found)'), "
                     f"'## package.json (first 2000 chars)' || {NL} || substring(package_json, 1, 2000), '## requirements.txt' || {NL} || substring(requirements, 1, 1000), "
                     f"'## Dockerfile content(s)' || {NL} || cut)",
    "09_unknowns_and_risks": f"'## Uncertain Areas (from explanation plan)' || {NL} || CASE WHEN ok THEN '[\"deployment\"]' ELSE '[\"Plan generation failed: the answer is not valid JSON\"]' END || {NL2} || '## Secrets Report' || {NL} "
                             f"|| '- Files scanned: ' || total_files_scanned || {NL} || '- Files with secrets: ' || files_with_secrets || {NL} || '- Secret types found: ' || {ends('none', TYPES_FOUND)} || {NL} "
                             f"|| '- High-risk files: ' || coalesce(risk, 'none') || {NL2} || '## Sample Secret Findings' || {NL} || coalesce(finds, '[]') || {NL2} || '## Tech Stack (for context)' || {NL} || tech_text",
}
_NODES = "repo_id, diagram, node_id, label, shape, CAST(pos AS BIGINT) AS pos"
_EDGES = "repo_id, diagram, source, target, arrow, label, CAST(pos AS BIGINT) AS pos"
_WORDS = ", ".join([f"CAST(len(regexp_extract_all(markdown, '{w}')) AS BIGINT) AS {w.lower()}" for w in vocab.CONFIDENCE_WORDS]
                   + [f"CAST(len(regexp_extract_all(markdown, '\\[{t}\\]')) AS BIGINT) AS tag_{t.lower().replace('-', '_')}" for t in vocab.CLAIM_TAGS])

QUERIES |= {
    "read_archives": f"SELECT repo_id, path, content, CAST(strlen(content) AS BIGINT) AS size FROM paths WHERE {no_dirs('parts', 'inventory')}",
    "bad_archives": "SELECT 'cut-' || repo_id || '.zip' AS archive, 'cut-' || repo_id AS repo_id, 'BadZipFile' AS error FROM repos",
    "damaged_members": "SELECT repo_id || '~' || p || '.zip' AS archive, repo_id || '~' || p AS repo_id, path FROM (SELECT repo_id, length(path) % 16 AS p, min(path) AS path "
                       f"FROM paths WHERE {no_dirs('parts', 'inventory')} GROUP BY 1, 2)",
    "bad_members_by_range": f"SELECT repo_id || '~' || p AS repo_id, path FROM (SELECT repo_id, length(path) % 16 AS p, min(path) AS path FROM paths WHERE {no_dirs('parts', 'inventory')} GROUP BY 1, 2)",
    "read_archives_by_range": f"SELECT repo_id, path, content, CAST(strlen(content) AS BIGINT) AS size FROM (SELECT *, min(path) OVER (PARTITION BY repo_id, length(path) % 16) AS lo "
                              f"FROM paths WHERE {no_dirs('parts', 'inventory')}) WHERE path <> lo",
    "read_tree": "SELECT repo_id, path, CAST(strlen(path) + 1 + strlen(content) AS BIGINT) AS size, md5(path || chr(10) || content) AS digest FROM files",
    "decode_text": "SELECT repo_id, path, CAST(length(content) + 2 AS BIGINT) AS n_chars, chr(65533) || 'A' AS tail FROM files",
    "artifacts": QUERIES["important_files"],
    "analysis_of_wrapped_repo": QUERIES["important_files"],
    "run_analysis": "SELECT repo_id, 'tech' AS kind, '' AS item, md5(concat_ws('#', " + ", ".join([*vocab.FACETS, "external_apis_detected"]) + ", docker::VARCHAR)) AS digest FROM stack "
                    "UNION ALL SELECT repo_id, 'important_files', path, md5(concat_ws('#', rank, score, reason_important, language, category)) FROM imp "
                    "UNION ALL SELECT repo_id, 'relationships', source || ' ' || relationship || ' ' || target, md5(evidence) FROM edges "
                    "UNION ALL SELECT repo_id, 'secrets_report', '', md5(concat_ws('#', total_files_scanned, files_with_secrets, secret_types_found, high_risk_count, findings)) FROM srep "
                    "UNION ALL SELECT repo_id, 'secret_findings', file, md5(array_to_string(types, '|')) FROM findings "
                    f"UNION ALL SELECT repo_id, 'high_risk_files', file, md5('') FROM findings WHERE list_has_any(types, {HIGH})",
    "artifacts_replaced": "SELECT repo_id, 'important_files' AS kind, path, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS rank FROM scored "
                          "WHERE score >= 50 AND (md5(repo_id) >= '5' OR length(path) % 2 = 0) QUALIFY rank <= 12 "
                          "UNION ALL SELECT repo_id, 'secret_findings', file, NULL FROM findings WHERE md5(repo_id) >= '5' OR length(file) % 2 = 0",
    "saved_validation_report": "SELECT repo_id, run_id, CASE WHEN md5(repo_id) < '5' THEN '' ELSE unresolved_file_paths END AS unresolved_file_paths, "
                               "unresolved_diagram_components, leaked_secrets_detected FROM report",
    "secret_findings": "SELECT repo_id, file, array_to_string(types, '|') AS secret_types FROM findings",
    "results_payload": """SELECT r.repo_id, r.run_id, md5(m.t) AS sections, md5(d.t) AS diagrams, coalesce(t.t, '') AS tech_summary, r.unresolved_file_paths, r.unresolved_diagram_components, r.leaked_secrets_detected FROM report r
        JOIN (SELECT repo_id, run_id, string_agg(section || '=' || markdown, '|' ORDER BY section) AS t FROM masked GROUP BY 1, 2) m USING (repo_id, run_id)
        JOIN (SELECT repo_id, run_id, string_agg(diagram || '=' || text, '|' ORDER BY diagram) AS t FROM drawn GROUP BY 1, 2) d USING (repo_id, run_id)
        LEFT JOIN (SELECT repo_id, string_agg(facet || '=' || replace(labels, '|', ','), '|' ORDER BY facet) AS t FROM stack_long GROUP BY 1) t USING (repo_id)""",
    "output_index": "SELECT repo_id, run_id, count(*) AS sections_ready, CAST(9 AS BIGINT) AS sections_expected, string_agg(section || ':' || strlen(markdown), '|' ORDER BY section) AS sections, "
                    "md5(repo_id) < '5' AND repo_id IN (SELECT repo_id FROM projects) AS plan_ready FROM sections GROUP BY 1, 2",
    "output_section": "SELECT repo_id, run_id, section, markdown FROM sections WHERE section = '06_main_user_flow'",
    "architecture_nodes": f"SELECT {_NODES} FROM arch_nodes", "architecture_edges": f"SELECT {_EDGES} FROM arch_edges",
    "flow_steps": "SELECT repo_id, run_id, step_no, num, action, file, participant FROM steps",
    "user_flow_nodes": f"SELECT run_id, {_NODES} FROM flow_nodes", "user_flow_edges": f"SELECT run_id, {_EDGES} FROM flow_edges",
    "repository_map_nodes": f"SELECT {_NODES} FROM map_nodes", "repository_map_edges": f"SELECT {_EDGES} FROM map_edges",
    "entity_nodes": f"SELECT {_NODES} FROM ent_nodes", "entity_edges": f"SELECT {_EDGES} FROM ent_edges",
    "diagram_text": "SELECT repo_id, diagram, text FROM diagrams",
    "flow_text": "SELECT repo_id, run_id, diagram, text FROM flow_text",
    "path_mentions": "SELECT repo_id, run_id, section, path FROM mentions",
    "unresolved_paths": "SELECT repo_id, run_id, section, path FROM bad_paths",
    "diagram_labels": "SELECT repo_id, run_id, diagram, label FROM labels0",
    "unresolved_components": "SELECT repo_id, run_id, diagram, component FROM bad_parts",
    "masked_sections": "SELECT repo_id, run_id, section, md5(markdown) AS digest FROM masked",
    "validation_report": "SELECT repo_id, run_id, unresolved_file_paths, unresolved_diagram_components, leaked_secrets_detected FROM report",
    "evidence_labels": f"SELECT repo_id, run_id, section, {_WORDS} FROM sections",
    "truncate_text": f"SELECT repo_id, path, md5({cap('content')}) AS digest, md5({cap('content', 3000, vocab.FILE_NOTE)}) AS file_digest, CAST(length(content) // 4 AS BIGINT) AS tokens FROM files",
    "file_prompts": f"SELECT repo_id, CAST(rank AS BIGINT) AS rank, path, 'File path   : ' || path || {NL} || 'Language    : ' || language || {NL} || 'Why notable : ' || reason_important || {NL2} "
                    f"|| '--- FILE CONTENT ---' || {NL} || {cap('content', 3000, vocab.FILE_NOTE)} || {NL} || '--- END ---' AS prompt FROM imp",
    "parse_model_json": "SELECT repo_id, path, responsibility, array_to_string(syms, '|') AS important_symbols, inputs, outputs, array_to_string(conns, '|') AS connections, snippet AS evidence_snippet FROM summaries",
    "compact_summaries": f"SELECT repo_id, string_agg(pline, {NL} ORDER BY rank) AS plan_text, string_agg(sline, {NL2} ORDER BY rank) AS section_text FROM sum_lines GROUP BY 1",
    "compact_relationships": f"SELECT repo_id, {rel_lines('TRUE', 40, _LINE)} AS all_lines, "
                             + ", ".join(f"coalesce({rel_lines(f'relationship = {q(k)}', n, _LINE, 'kr')}, '') AS {k}_lines" for k, n in (("declares_route", 30), ("imports", 30), ("calls_api", 20)))
                             + f", coalesce({rel_lines(f'relationship = {q('declares_route')}', 30, _SHORT, 'kr')}, '') AS plan_routes, "
                               "count(*) FILTER (relationship = 'declares_route') AS n_routes FROM ranked_edges GROUP BY 1",
    "compact_tech": "SELECT repo_id, tech_text, plan_tech_text FROM techt",
    "plan_prompts": f"SELECT repo_id, {cap('t')} AS prompt FROM (SELECT p.repo_id, concat_ws({NL2}, '## Product Description (user-provided)' || {NL} || product_description, "
                    f"'## Key Features (user-provided)' || {NL} || important_features, '## Technology Stack' || {NL} || plan_tech_text, '## Important Files (with LLM summaries)' || {NL} || coalesce(s.t, ''), "
                    f"'## Declared API Routes' || {NL} || coalesce(r.t, 'No routes detected.')) AS t FROM projects p LEFT JOIN techt USING (repo_id) "
                    f"LEFT JOIN (SELECT repo_id, string_agg(pline, {NL} ORDER BY rank) AS t FROM sum_lines GROUP BY 1) s USING (repo_id) "
                    f"LEFT JOIN (SELECT repo_id, string_agg('• ' || source || ': ' || target, {NL} ORDER BY kr) AS t FROM ranked_edges WHERE relationship = 'declares_route' AND kr <= 30 GROUP BY 1) r USING (repo_id))",
    "parse_plan": "SELECT repo_id, major_modules, explanation_order, main_user_flow_target, required_diagrams, concepts_needing_analogies, uncertain_areas FROM plans",
    "level_style": "SELECT repo_id, l AS level, CASE l " + " ".join(f"WHEN '{n}' THEN {lit(style_text(n))}" for n in vocab.LEVELS)
                   + f" END AS style FROM (SELECT repo_id, CASE WHEN technical_level IN {in_list(vocab.LEVELS)} THEN technical_level ELSE 'beginner' END AS l FROM projects)",
    "setup_files": "SELECT repo_id, readme, package_json, requirements, dockerfiles FROM setup",
    "section_prompts": " UNION ALL ".join(f"SELECT repo_id, '{s}' AS section, {cap('t')} AS prompt FROM (SELECT repo_id, {p} AS t FROM ctx c)" for s, p in _PROMPTS.items()),
    "apply_text_model": f"""SELECT repo_id, CAST(rank AS BIGINT) AS rank, path, CASE WHEN length(prompt) % 4 <> 0 THEN upper(split_part(prompt, {NL}, 1)) END AS answer,
        CASE WHEN length(prompt) % 4 = 0 THEN 'no answer' END AS error FROM (SELECT repo_id, rank, path, 'File path   : ' || path || {NL} || 'Language    : ' || language || {NL} || 'Why notable : ' || reason_important || {NL2}
        || '--- FILE CONTENT ---' || {NL} || {cap('content', 3000, vocab.FILE_NOTE)} || {NL} || '--- END ---' AS prompt FROM imp)""",
    "stream_inventory": QUERIES["inventory"],
    "stream_edges": QUERIES["dedupe_relationships"],
    "stream_secrets": QUERIES["scan_secrets"],
    "stream_latest_status": QUERIES["latest_status"],
    "stream_relationships": "SELECT repo_id, source, relationship, target, evidence, CASE length(source) % 3 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS times FROM edges WHERE length(source) % 3 < 2",
    "stream_current_edges": QUERIES["dedupe_relationships"],
    "stream_current_inventory": QUERIES["inventory"],
    "stream_facts": QUERIES["dedupe_relationships"],
}
QUERIES |= {"saved_plan": QUERIES["parse_plan"], "stream_files": QUERIES["read_archives"], "stream_bad_archives": QUERIES["bad_archives"]}

#: Tables that some queries see otherwise. Files that came again: their newest versions.
_NEWEST = {"files": f"""SELECT repo_id, path, CASE length(path) % 3 WHEN 0 THEN content || chr(10) || 'import changed' || chr(10) || 'fetch(''/api/changed'')'
    WHEN 1 THEN content ELSE 'import fresh' || chr(10) || 'fetch(''/api/fresh'')' END AS content FROM ({fixtures.FILES_SQL})"""}
TABLES: dict[str, dict[str, str]] = {"stream_current_edges": _NEWEST, "stream_current_inventory": _NEWEST}
