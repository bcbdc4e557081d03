"""Rule scoring of paths and the most important files of every repository."""
from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, vocab
from ..functions.lookups import array_literal, contains_any, overlaps
from .ranking import top_n


class Rule(NamedTuple):
    """A score for paths that pass any of the tests and, if given, have one of ``exts``.

    ``parts`` compares every path part including the file name, ``folders`` leaves the name out.
    """
    score: int
    reason: str
    names: tuple = ()
    parts: tuple = ()
    folders: tuple = ()
    stem_has: tuple = ()
    name_has: tuple = ()
    stem_starts: str = ""
    exts: tuple = ()


# The rules in evaluation order.
RULES = [
    Rule(100, "Application entry point", names=("main.py", "app.py", "server.py", "index.py", "run.py", "manage.py",
                                                "wsgi.py", "asgi.py")),
    Rule(100, "Application entry point", names=("index.js", "index.ts", "server.js", "server.ts", "app.js", "app.ts",
                                                "main.js", "main.ts")),
    Rule(90, "Next.js / framework layout root", names=("layout.tsx", "layout.ts", "layout.jsx", "layout.js",
                                                       "_app.tsx", "_app.js", "_document.tsx")),
    Rule(85, "Route definitions file", parts=("routes", "router", "routers"), exts=(".py", ".ts", ".js", ".tsx")),
    Rule(80, "Controller file", parts=("controllers", "controller"), exts=(".py", ".ts", ".js")),
    Rule(80, "API handler or route file", parts=("api", "handlers", "handler"), exts=(".py", ".ts", ".js", ".tsx")),
    Rule(75, "Service / business logic file", parts=("services", "service", "usecases", "use_cases"),
         exts=(".py", ".ts", ".js")),
    Rule(70, "Data model or schema definition",
         parts=("models", "model", "schemas", "schema", "entities", "entity"), exts=(".py", ".ts", ".js", ".prisma")),
    Rule(70, "Prisma schema", names=("schema.prisma",)),
    Rule(65, "Frontend page component", parts=("pages", "page"), exts=(".tsx", ".jsx")),
    Rule(60, "Shared UI component", parts=("components", "component"), exts=(".tsx", ".jsx")),
    Rule(85, "Authentication logic", stem_has=("auth",), folders=("auth",)),
    Rule(80, "AI prompt definitions", parts=("prompts", "prompt"), stem_has=("prompt",)),
    Rule(75, "LLM / AI agent code", stem_has=("agent", "llm", "ai", "chain", "graph")),
    Rule(65, "Environment variable template", names=(".env.example", ".env.template", ".env.sample",
                                                     ".env.local.example")),
    Rule(60, "Docker Compose configuration", names=("docker-compose.yml", "docker-compose.yaml",
                                                    "docker-compose.dev.yml", "docker-compose.prod.yml")),
    Rule(55, "Dockerfile", name_has=("dockerfile",)),
    Rule(55, "Core config file", names=("next.config.ts", "next.config.js", "vite.config.ts", "vite.config.js",
                                        "webpack.config.js", "tailwind.config.ts", "pyproject.toml", "setup.py",
                                        "setup.cfg")),
    Rule(50, "Project README / documentation", stem_starts="readme", exts=(".md", ".rst", ".txt", "")),
    Rule(60, "Middleware definition", name_has=("middleware",), exts=(".py", ".ts", ".js")),
    Rule(55, "Database migration file", parts=("migrations", "migration", "alembic"),
         exts=(".py", ".sql", ".ts", ".js")),
]
NO_REASON = "Matched heuristic"


def _matches(rule: Rule) -> Column:
    """Test of one rule over the helper columns of ``score_files``."""
    tests = []
    if rule.names:
        tests.append(F.col("_name").isin(list(rule.names)))
    if rule.parts:
        tests.append(overlaps(F.col("_parts"), rule.parts))
    if rule.folders:
        tests.append(overlaps(F.col("_folders"), rule.folders))
    if rule.stem_has:
        tests.append(contains_any(F.col("_stem"), rule.stem_has))
    if rule.name_has:
        tests.append(contains_any(F.col("_name"), rule.name_has))
    if rule.stem_starts:
        tests.append(F.startswith("_stem", F.lit(rule.stem_starts)))
    hit = reduce(or_, tests)
    return hit & F.col("_ext").isin(list(rule.exts)) if rule.exts else hit


def score_files(inv: DataFrame, rules: list[Rule] = RULES, min_score: int | None = None) -> DataFrame:
    """Adds score and reason_important; with ``min_score``, only rows that reach it.

    The score is the sum of all matched rules. The reason comes from the last matched rule
    that scores more than everything matched before it. Path parts and points are columns
    of their own projections, so each is computed once per row.
    """
    path, given = F.col("path"), [F.col(c) for c in inv.columns]
    low = F.lower(path)
    parted = inv.select(*given, F.lower(paths.name(path)).alias("_name"), F.lower(paths.stem(path)).alias("_stem"),
                        paths.extension(path).alias("_ext"), F.split(low, "/").alias("_parts"), paths.dirs(low).alias("_folders"))
    points = F.array(*[F.when(_matches(r), r.score).otherwise(0) for r in rules])
    pointed = parted.select(*given, points.alias("_points"))
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("seen"), F.lit(0).alias("rule"))
    folded = F.aggregate("_points", start, lambda acc, p: F.struct(
        (acc.score + p).alias("score"), (acc.seen + 1).alias("seen"),
        F.when(p > acc.score, acc.seen + 1).otherwise(acc.rule).alias("rule")))
    reasons = array_literal([NO_REASON, *[r.reason for r in rules]])
    scored = pointed.select(*given, folded.alias("_s"))
    if min_score is None:
        s = scored
    else:
        # A generator instead of a filter, which would be pushed down and score every row twice.
        s = scored.select(*given, F.explode(F.when(F.col("_s.score") >= min_score, F.array("_s"))).alias("_s"))
    return s.select(*given, F.col("_s.score").alias("score"), F.element_at(reasons, F.col("_s.rule") + 1).alias("reason_important"))


def important_files(inv: DataFrame, max_files: int = vocab.MAX_IMPORTANT_FILES,
                    min_score: int = vocab.MIN_IMPORTANT_SCORE, rules: list[Rule] = RULES,
                    keep: list[str] | None = None) -> DataFrame:
    """The best files of every repository, score descending, then path.

    Every map task keeps at most ``max_files`` rows per repository before the shuffle, so
    columns named in ``keep`` (the content, say) ride along for the few rows that can still
    win, instead of joining the whole file table again afterwards.
    """
    scored = score_files(inv.filter("included"), rules, min_score)
    best = top_n(scored, ["repo_id"], [F.col("score").desc(), F.col("path")], max_files)
    return best.select("repo_id", "rank", "path", "reason_important", "score", "language", "category", *(keep or []))
