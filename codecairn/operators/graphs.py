"""Diagram graphs as node and edge tables, and their text.

Nodes are (repo_id, diagram, pos, node_id, label, shape), edges are (repo_id, diagram, pos,
source, target, arrow, label). ``pos`` orders all lines of one diagram. Flows add run_id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths, text, vocab
from ..functions.lookups import array_literal, contains_any
from .ranking import top_n

ARCHITECTURE, USER_FLOW, REPOSITORY_MAP, ENTITIES = (
    "system_architecture.mmd", "main_user_flow.mmd", "repository_map.mmd", "database_erd.mmd")
# Patterns in the subset that Java and RE2 read alike, and limits.
STEP = r"(?i)\*{0,2}Step\s*(\d+)\s*[-—:]\s*([^\n]*)$"
STEP_NOISE = r"""\*\*|[`'"]"""
STEP_FILE = r"(?i)-\s*\*\*File\*\*\s*:\s*`?([a-zA-Z0-9_\-./\\:]+)`?"
ENTITY_PATTERNS = [r"(?m)^model\s+([A-Za-z0-9_]+)\s*\{",
                   r"(?m)^class\s+([A-Za-z0-9_]+)\s*\([^\n]*Model[^\n]*\)\s*:",
                   r"(?m)^class\s+([A-Za-z0-9_]+)\s*\([^\n]*Base[^\n]*\)\s*:"]
MODEL_PATHS = ["model.py", "models/", "schema.prisma", "migrations/"]
MAX_HOSTS, MAX_FOLDERS, MAX_ENTITIES, MAX_STEP_LABEL = 3, 25, 10, 40


def _node(pos, node_id, label, shape: str) -> Column:
    return F.struct(F.lit(pos).alias("pos"), F.lit(node_id).alias("node_id"), label.alias("label"), F.lit(shape).alias("shape"))


def _edge(pos, source: str, target: str, arrow: str = "-->") -> Column:
    return F.struct(F.lit(pos).alias("pos"), F.lit(source).alias("source"), F.lit(target).alias("target"),
                    F.lit(arrow).alias("arrow"), F.lit(None).cast("string").alias("label"))


def _titled(title: str, values: Column) -> Column:
    """``Title\\n(a, b)`` with a literal backslash, or the title alone."""
    return F.when(F.size(values) > 0, F.concat(F.lit(title + "\\n("), F.array_join(values, ", "), F.lit(")"))) \
        .otherwise(F.lit(title))


def architecture_graph(stack: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User, frontend, backend and database with their labels; AI and external services when present."""
    remote = F.filter("external_apis_detected", lambda a: F.contains(a, F.lit("//")))
    hosts = F.array_sort(F.array_distinct(F.transform(
        remote, lambda a: F.substring_index(F.substring_index(a, "//", -1), "/", 1))))
    shown = F.when(F.size(hosts) > 0, F.slice(hosts, 1, MAX_HOSTS)).otherwise(F.array(F.lit("External APIs")))
    has_ai, has_api = F.size("ai_llm_libraries") > 0, F.size("external_apis_detected") > 0
    nodes = F.array(
        _node(0, "User", F.lit("User"), "round"),
        _node(1, "Frontend", _titled("Frontend", F.col("frontend_frameworks")), "box"),
        _node(2, "Backend", _titled("Backend", F.col("backend_frameworks")), "box"),
        _node(3, "Database", _titled("Database", F.col("databases")), "store"),
        F.when(has_ai, _node(7, "AIService", _titled("AI / LLM Services", F.col("ai_llm_libraries")), "box")),
        F.when(has_api, _node(9, "ExtAPI", _titled("External Services", shown), "box")),
        F.when(F.col("docker"), _node(11, "Container", F.lit("Containerized with Docker"), "note")))
    edges = F.array(_edge(4, "User", "Frontend"), _edge(5, "Frontend", "Backend"), _edge(6, "Backend", "Database"),
                    F.when(has_ai, _edge(8, "Backend", "AIService")), F.when(has_api, _edge(10, "Backend", "ExtAPI")))
    named = [F.col("repo_id"), F.lit(ARCHITECTURE).alias("diagram")]
    return (stack.select(*named, F.explode(F.array_compact(nodes)).alias("n")).select("repo_id", "diagram", "n.*"),
            stack.select(*named, F.explode(F.array_compact(edges)).alias("e")).select("repo_id", "diagram", "e.*"))


def _participant(file: Column) -> Column:
    low, out = F.lower(file), F.lit(vocab.DEFAULT_PARTICIPANT)
    for name, words in reversed(vocab.PARTICIPANT_CLASSES.items()):
        out = F.when(contains_any(low, words), F.lit(name)).otherwise(out)
    return out


def _with_steps(flows: DataFrame) -> DataFrame:
    """(repo_id, run_id, steps): the steps of every document as one array on its row.

    Step and File lines are the events of a document. A File line belongs to a step exactly
    when the event before it is a Step line, so no running state is needed.
    """
    step, file = F.lit(STEP), F.lit(STEP_FILE)
    marked = F.transform(F.split("markdown", "\n"), lambda line: F.struct(
        F.when(F.rlike(line, step), F.regexp_extract(line, STEP, 1)).alias("num"),
        text.strip(F.regexp_replace(F.regexp_extract(line, STEP, 2), STEP_NOISE, "")).alias("action"),
        F.when(F.rlike(line, file), F.regexp_extract(line, STEP_FILE, 1)).alias("file")))
    events = F.filter(marked, lambda x: x.num.isNotNull() | x.file.isNotNull())
    found = flows.select("repo_id", "run_id", events.alias("ev"))
    pairs = F.transform("ev", lambda x, i: F.struct(F.get("ev", i - 1).alias("step"), x.alias("at")))
    steps = F.filter(pairs, lambda p: p.at.num.isNull() & p.step.num.isNotNull())
    return found.select("repo_id", "run_id", F.transform(steps, lambda p: F.struct(
        p.step.num.alias("num"), p.step.action.alias("action"), p.at.file.alias("file"),
        _participant(p.at.file).alias("participant"))).alias("steps"))


def flow_steps(flows: DataFrame) -> DataFrame:
    """(repo_id, run_id, step_no, num, action, file, participant) of documents (repo_id, run_id, markdown)."""
    return _with_steps(flows).select("repo_id", "run_id", F.posexplode("steps").alias("i", "s")).select(
        "repo_id", "run_id", (F.col("i") + 1).alias("step_no"), "s.num", "s.action", "s.file", "s.participant")


def user_flow(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Participants and messages of every flow document; a fixed flow for documents without steps.

    Both are arrays made on the row of the document and exploded once; nothing is shuffled.
    """
    keys = ["repo_id", "run_id"]
    docs, has_steps = _with_steps(flows), F.size("steps") > 0
    parts = F.col("steps.participant")

    default_people = array_literal(dict.fromkeys(x for a, b, _, _ in vocab.DEFAULT_FLOW for x in (a, b)))
    people = F.when(has_steps, F.array_distinct(F.concat(F.array(F.lit("User")), parts))).otherwise(default_people)
    nodes = docs.select(*keys, F.posexplode(people).alias("pos", "node_id")).select(
        *keys, F.lit(USER_FLOW).alias("diagram"), "pos", "node_id", F.col("node_id").alias("label"),
        F.when(F.col("node_id") == "User", "actor").otherwise("participant").alias("shape"))

    first = 10  # messages follow all participants; there are at most six of those

    def message(pos, source, target, arrow, label) -> Column:
        pos, source, target, label = [x if isinstance(x, Column) else F.lit(x) for x in (pos, source, target, label)]
        return F.struct(pos.alias("pos"), source.alias("source"), target.alias("target"), F.lit(arrow).alias("arrow"),
                        label.alias("label"))

    def sent(step: Column, i: Column) -> Column:
        label = F.concat(F.lit("Step "), step.num, F.lit(": "), step.action)
        cut = F.when(F.length(label) > MAX_STEP_LABEL, F.concat(F.substring(label, 1, MAX_STEP_LABEL - 3), F.lit("..."))) \
            .otherwise(label)
        before = F.coalesce(F.get(F.col("steps"), i - 1).participant, F.lit("User"))
        return message(i + first, before, step.participant, "->>", cut)

    back = message(F.size("steps") + first, F.try_element_at(parts, F.lit(-1)), "User", "-->>", "Completed Flow")
    fixed = F.array(*[message(first + i, a, b, arrow, t) for i, (a, b, arrow, t) in enumerate(vocab.DEFAULT_FLOW)])
    messages = F.when(has_steps, F.concat(F.transform("steps", sent), F.array(back))).otherwise(fixed)
    edges = docs.select(*keys, F.lit(USER_FLOW).alias("diagram"), F.explode(messages).alias("m")).select(*keys, "diagram", "m.*")
    return nodes, edges


def repository_map(inv: DataFrame, max_nodes: int = MAX_FOLDERS) -> tuple[DataFrame, DataFrame]:
    """Folders of the first two levels, first by name; children point from their parent or the root."""
    p, depth = F.col("path"), paths.depth(F.col("path"))
    two = F.substring_index(p, "/", 2)
    found = F.array_compact(F.array(F.when(depth > 1, paths.top_dir(p)), F.when(depth > 2, two)))
    folders = top_n(inv.select("repo_id", F.explode(found).alias("folder")).distinct(), ["repo_id"],
                    [F.col("folder")], max_nodes)

    def node_id(col: Column) -> Column:
        return F.translate(col, "/.-", "___")

    f = F.col("folder")
    named = folders.select("repo_id", "rank", node_id(f).alias("id"), F.substring_index(f, "/", -1).alias("name"),
                           F.when(F.contains(f, F.lit("/")), node_id(F.substring_index(f, "/", 1)))
                           .otherwise(F.lit("root")).alias("parent"))
    diagram = F.lit(REPOSITORY_MAP).alias("diagram")
    roots = inv.select("repo_id").distinct().select(
        "repo_id", diagram, F.lit(0).alias("pos"), F.lit("root").alias("node_id"), F.lit("Repository Root").alias("label"),
        F.lit("box").alias("shape"))
    nodes = roots.unionByName(named.select("repo_id", diagram, (2 * F.col("rank") - 1).alias("pos"), F.col("id").alias("node_id"),
                                           F.concat(F.lit("📁 "), "name").alias("label"), F.lit("box").alias("shape")))
    edges = named.select("repo_id", diagram, (2 * F.col("rank")).alias("pos"), F.col("parent").alias("source"),
                         F.col("id").alias("target"), F.lit("-->").alias("arrow"), F.lit(None).cast("string").alias("label"))
    return nodes, edges


def entity_names(content: Column) -> Column:
    """Distinct entity names of one model file; (?d) keeps line starts at newlines only."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit("(?d)" + p), F.lit(1)) for p in ENTITY_PATTERNS]))


def entity_graph(important: DataFrame, max_entities: int = MAX_ENTITIES) -> tuple[DataFrame, DataFrame]:
    """Entities of the model files among the important files (with their content), chained in name order.

    Repositories whose model files name no entity get two default ones; without model files, no rows.
    """
    models = important.filter(contains_any(F.lower("path"), MODEL_PATHS)) \
        .select("repo_id", entity_names(F.coalesce("content", F.lit(""))).alias("names"))
    found = models.select("repo_id", F.explode("names").alias("name")).distinct()
    none_found = models.groupBy("repo_id").agg(F.max(F.size("names")).alias("n")).filter("n = 0") \
        .select("repo_id", F.posexplode(array_literal(vocab.DEFAULT_ENTITIES)).alias("i", "name")) \
        .select("repo_id", (F.col("i") + 1).alias("rank"), "name")
    ranked = top_n(found, ["repo_id"], [F.col("name")], max_entities).unionByName(none_found)
    following = ranked.withColumn("next", F.lead("name").over(Window.partitionBy("repo_id").orderBy("rank")))
    diagram = F.lit(ENTITIES).alias("diagram")
    nodes = ranked.select("repo_id", diagram, F.col("rank").alias("pos"), F.col("name").alias("node_id"),
                          F.col("name").alias("label"), F.lit("entity").alias("shape"))
    edges = following.filter("next is not null").select(
        "repo_id", diagram, (F.col("rank") + max_entities).alias("pos"), F.col("name").alias("source"),
        F.col("next").alias("target"), F.lit("||--o{").alias("arrow"), F.lit("relates").alias("label"))
    return nodes, edges


_HEADERS = {ARCHITECTURE: "flowchart TD", REPOSITORY_MAP: "flowchart TD", USER_FLOW: "sequenceDiagram", ENTITIES: "erDiagram"}


def _node_line() -> Column:
    n, label, shape = F.col("node_id"), F.col("label"), F.col("shape")
    box = F.concat(F.lit("    "), n)
    return (F.when(shape == "round", F.concat(box, F.lit("(["), label, F.lit("])")))
            .when(shape == "store", F.concat(box, F.lit('[(" '), label, F.lit(' ")]')))
            .when(shape == "note", F.concat(F.lit("    %% "), label))
            .when(shape.isin("actor", "participant"), F.concat(F.lit("    "), shape, F.lit(" "), n))
            .when(shape == "entity", F.concat(box, F.lit(" {\n        string id PK\n        string name\n    }")))
            .otherwise(F.concat(box, F.lit('["'), label, F.lit('"]'))))


def _edge_line() -> Column:
    a, b, arrow, label = F.col("source"), F.col("target"), F.col("arrow"), F.col("label")
    spaced = F.concat(F.lit("    "), a, F.lit(" "), arrow, F.lit(" "), b)
    return (F.when(F.col("diagram") == USER_FLOW, F.concat(F.lit("    "), a, arrow, b, F.lit(": "), label))
            .when(label.isNotNull(), F.concat(spaced, F.lit(" : "), label))
            .otherwise(spaced))


def diagram_text(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, diagram, text): header, then nodes and edges in ``pos`` order.

    One group is one diagram, whose size the graph operators bound.
    """
    keys = [*(keys or ["repo_id"]), "diagram"]
    rows = nodes.select(*keys, F.col("pos").cast("int").alias("pos"), _node_line().alias("line")) \
        .unionByName(edges.select(*keys, F.col("pos").cast("int").alias("pos"), _edge_line().alias("line")))
    header = F.lit(None).cast("string")
    for name, head in _HEADERS.items():
        header = F.when(F.col("diagram") == name, head).otherwise(header)
    body = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy(*keys).agg(body.alias("body")).select(
        *keys, F.concat_ws("\n", header, F.array_join(F.col("body.line"), "\n")).alias("text"))
