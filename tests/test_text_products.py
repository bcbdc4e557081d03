from pyspark.sql import functions as F

from codecairn.functions import text
from codecairn.operators import graphs, inventory, prompts, scoring, status, validate


def flow_edges(spark, markdown):
    df = spark.createDataFrame([("r", "1", markdown)], "repo_id string, run_id string, markdown string")
    return [(r.source, r.target, r.arrow, r.label) for r in graphs.user_flow(df)[1].orderBy("pos").collect()]


def test_flow_pairs_step_with_first_file(spark):
    md = ("**Step 1 — open `app`**\n- **File**: `src/pages/a.tsx`\n- **File**: `ignored.py`\nStep 2: dropped\n"
          "**Step 3 - " + "x" * 50 + "**\n- **File**: server/services/s.py\nStep 4: no file")
    got = flow_edges(spark, md)
    assert got == [("User", "Frontend", "->>", "Step 1: open app"), ("Frontend", "Service", "->>", "Step 3: " + "x" * 29 + "..."),
                   ("Service", "User", "-->>", "Completed Flow")]


def test_flow_without_steps_is_the_fixed_one(spark):
    got = flow_edges(spark, "nothing here\n- **File**: `a.py`")
    assert len(got) == 6 and got[0] == ("User", "Frontend", "->>", "Access Application")


def entity(spark, files, contents):
    imp = scoring.important_files(inventory.inventory(files(contents), ["content"]), keep=["content"])
    nodes, edges = graphs.entity_graph(imp)
    return [r.label for r in nodes.orderBy("pos").collect()], edges.count()


def test_entities(spark, files):
    assert entity(spark, files, {"main.py": "class A(Model): pass"}) == ([], 0)
    assert entity(spark, files, {"models/main.py": "x = 1"}) == (["User", "Session"], 1)
    got = entity(spark, files, {"models/main.py": "class B(Base):\nclass A(db.Model):\n  class C(Base):", "schema.prisma": "model Z {\n}"})
    assert got == (["A", "B", "Z"], 2)


def test_repository_map_and_text(spark, files):
    inv = inventory.inventory(files({"a-b/c.d/e/f.py": "", "a-b/x.py": "", "r.py": ""}))
    t = graphs.diagram_text(*graphs.repository_map(inv)).first().text
    assert t.split("\n") == ["flowchart TD", '    root["Repository Root"]', '    a_b["📁 a-b"]', "    root --> a_b",
                             '    a_b_c_d["📁 c.d"]', "    a_b --> a_b_c_d"]


def test_components_match_both_ways(spark):
    labels = spark.createDataFrame([("r", "d", x) for x in ("User", "Auth", "src/auth.py (main)", "Ghost")], "repo_id string, diagram string, label string")
    known = spark.createDataFrame([("r", "src/auth.py"), ("other", "ghost")], "repo_id string, component string")
    got = [r.component for r in validate.unresolved_components(labels, known).collect()]
    assert got == ["Ghost"]


def test_label_forms(spark):
    df = spark.createDataFrame([("r", "d", 'A["x y"] B[(" z ")] C(w)\nactor U\nparticipant P-1')], "repo_id string, diagram string, text string")
    assert {r.label for r in validate.diagram_labels(df).collect()} == {"x y", '(" z ")', "w", "U", "P-1"}


def test_path_mentions(spark):
    md = "see src/a.py, http://x.com/a.js www.b.co 1.5 Node.js and a/b/.env.example"
    df = spark.createDataFrame([("r", "1", "s", md)], "repo_id string, run_id string, section string, markdown string")
    got = {r.path for r in validate.path_mentions(df).collect()}
    assert {"src/a.py", "Node.js"} <= got and not any(p in got for p in ("1.5", "www.b.co"))


def test_parse_model_json(spark):
    rows = [("a", '{"responsibility": "x", "important_symbols": ["s"], "connections": null}'), ("b", "  plain " + "y" * 600), ("c", None), ("d", "[1]"), ("e", "")]
    got = {r.k: r for r in prompts.parse_model_json(spark.createDataFrame(rows, "k string, answer string")).collect()}
    assert got["a"].responsibility == "x" and got["a"].important_symbols == ["s"] and got["a"].connections == []
    assert len(got["b"].responsibility) == 500 and got["b"].responsibility.startswith("plain")
    assert got["c"].responsibility == got["e"].responsibility == "Summarisation failed." and got["d"].responsibility == "[1]"


def test_truncate_and_tokens(spark):
    r = spark.createDataFrame([("é" * 12,)], "t string").select(text.truncate_text(F.col("t"), 10, "…").alias("a"), text.truncate_text(F.col("t"), 12, "…").alias("b"),
                                                               text.estimate_tokens(F.col("t")).alias("n")).first()
    assert (r.a, r.b, r.n) == ("é" * 10 + "…", "é" * 12, 3)


def test_levels(spark):
    df = spark.createDataFrame([("a", None), ("b", "expert"), ("c", "developer")], "repo_id string, technical_level string")
    got = {r.repo_id: r.level for r in prompts.level_style(df).collect()}
    assert got == {"a": "beginner", "b": "beginner", "c": "developer"}


def test_status(spark):
    log = spark.createDataFrame([(1, 1, "extracted", 1), (1, 2, "complete", 2), (2, 5, "odd", 3)], "project_id int, ts int, status string, event_id int")
    got = {r.project_id: (r.stage, r.progress, r.is_complete, r.can_generate) for r in status.status_view(status.latest_status(log)).collect()}
    assert got == {1: ("Generation complete", 100, True, True), 2: ("odd", 0, False, False)}


def test_high_risk_text_is_exact_before_the_cut(spark):
    df = spark.createDataFrame([("r", f"f{i:05}", ["Slack Token"]) for i in range(5000)], "repo_id string, file string, secret_types array<string>")
    whole = ", ".join(f"f{i:05}" for i in range(5000))
    got = prompts.high_risk_text(df).first().high_risk_text
    assert len(got) > 10_000 and whole.startswith(got)


def test_failed_model_call_is_a_row(spark):
    def model(system, prompt):
        raise RuntimeError("down")
    rows = spark.createDataFrame([("r", "01_start_here", "s", "p")], "repo_id string, section string, system_prompt string, prompt string")
    r = prompts.sections_from_answers(prompts.apply_text_model(rows, model)).first()
    assert r.markdown.startswith("# 01 Start Here\n\n> ⚠️") and "down" in r.markdown


def test_a_diagram_of_all_runs_is_read_once(spark, monkeypatch):
    texts = {"architecture": "A[Ghost box] --> B[main.py]", "entity": "X[\"db\"] --> Y(Other)"}
    rows = [(repo, f"run-{k}", d, t) for repo in ("r", "s") for k in range(30) for d, t in texts.items()]
    rows += [("r", f"run-{k}", "main_user_flow", f"participant p{k % 3}") for k in range(30)]
    rows += [("r", "run-0", "architecture", "Z[Second text]"), ("r", "run-1", "none", None), ("r", None, "entity", texts["entity"]), (None, "run-1", "entity", texts["entity"])]
    diagrams = spark.createDataFrame(rows, "repo_id string, run_id string, diagram string, text string")
    known = spark.createDataFrame([("r", "src/main.py"), ("r", "p1"), ("s", "y(other"), ("t", "ghost box")], "repo_id string, component string")
    want = validate.unresolved_components(validate.diagram_labels(diagrams), known).collect()
    seen, labels = [], validate.diagram_labels
    monkeypatch.setattr(validate, "diagram_labels", lambda df: (seen.append(df.count()), labels(df))[1])
    got = validate.unresolved_in_diagrams(diagrams, known).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 150
    assert len(seen) == 1 and seen[0] < 12  # distinct texts of a repository, not runs
