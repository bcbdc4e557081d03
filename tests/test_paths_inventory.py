import pytest
from pyspark.sql import functions as F

from codecairn.operators import inventory as inv, scoring

# Golden values: path, reason, score, language, category of two analysed sample projects.
GOLDEN = [
    ("api/index.js", "Application entry point", 180, "JavaScript", "backend_route"),
    ("server/routes/auth.js", "Route definitions file", 170, "JavaScript", "backend_route"),
    ("src/pages/Auth.jsx", "Authentication logic", 150, "JavaScript (JSX)", "frontend_component"),
    ("server/middleware/authMiddleware.js", "Authentication logic", 145, "JavaScript", "other"),
    ("server/server.js", "Application entry point", 100, "JavaScript", "backend_route"),
    ("server/routes/tasks.js", "Route definitions file", 85, "JavaScript", "backend_route"),
    ("src/main.jsx", "LLM / AI agent code", 75, "JavaScript (JSX)", "frontend_component"),
    ("tailwind.config.js", "LLM / AI agent code", 75, "JavaScript", "config"),
    ("server/models/Task.js", "Data model or schema definition", 70, "JavaScript", "model"),
    (".env.example", "Environment variable template", 65, "Unknown", "config"),
    ("src/server/routers/auth.ts", "Route definitions file", 170, "TypeScript", "other"),
    ("src/app/api/auth/[...nextauth]/route.ts", "Authentication logic", 165, "TypeScript", "backend_route"),
    ("mcp-server/index.ts", "Application entry point", 100, "TypeScript", "other"),
    ("src/app/(auth)/layout.tsx", "Next.js / framework layout root", 90, "TypeScript (JSX)", "frontend_component"),
    ("src/lib/auth.config.ts", "Authentication logic", 85, "TypeScript", "other"),
    ("src/server/routers/_app.ts", "Route definitions file", 85, "TypeScript", "other"),
]


def test_golden_scores(spark, files):
    scored = scoring.score_files(inv.inventory(files({g[0]: "x" for g in GOLDEN}))).collect()
    got = {(r.path, r.reason_important, r.score, r.language, r.category) for r in scored}
    assert got == set(GOLDEN)


def test_important_files_order_cap_and_minimum(spark, files):
    many = files({f"r{i:02}/main.py": "" for i in range(15)} | {"src/util.go": "", "readme.md": ""})
    best = scoring.important_files(inv.inventory(many)).orderBy("rank").collect()
    assert [r.path for r in best] == [f"r{i:02}/main.py" for i in range(12)]
    assert all(r.score >= 50 for r in best)


@pytest.mark.parametrize("path,name,stem,ext,depth,top", [
    (".gitignore", ".gitignore", ".gitignore", "", 1, None),
    (".env.example", ".env.example", ".env", ".example", 1, None),
    ("a.tar.gz", "a.tar.gz", "a.tar", ".gz", 1, None),
    ("d/Makefile", "Makefile", "Makefile", "", 2, "d"),
    ("d/e/X.PY", "X.PY", "X", ".py", 3, "d"),
    ("d/x.", "x.", "x.", "", 2, "d"),
])
def test_path_parts(spark, files, path, name, stem, ext, depth, top):
    r = inv.path_parts(files({path: ""})).first()
    assert (r["name"], r.stem, r.extension, r.depth, r.top_dir) == (name, stem, ext, depth, top)


def test_safe_paths(spark, files):
    given = {"a/../../b": 1, "/etc/x": 1, "a\\b": 1, "a/./c//d": 1, "a/../e": 1, "../f": 1, "..": 1, ".": 1}
    got = {r.path for r in inv.safe_paths(files({p: "" for p in given})).collect()}
    assert got == {"a/b", "a/c/d", "e"}


def test_strip_repo_root(spark, files):
    one = files({"top/a.py": "", "top/b/c.py": "", "node_modules/x.js": ""}, "one")
    two = files({"x/a.py": "", "y/b.py": ""}, "two")
    root = files({"x/a.py": "", "b.py": ""}, "root")
    got = {(r.repo_id, r.path) for r in inv.strip_repo_root(one.union(two).union(root)).collect()}
    assert got == {("one", "a.py"), ("one", "b/c.py"), ("two", "x/a.py"), ("two", "y/b.py"), ("root", "x/a.py"), ("root", "b.py")}


def test_skip_dirs_inventory_looks_at_folders_only(spark, files):
    df = files({"build": "", "build/x.py": "", "a/target/y.py": "", "target.py": ""})
    assert {r.path for r in inv.skip_dirs(df).collect()} == {"build", "target.py"}
    assert {r.path for r in inv.skip_dirs(df, "relations").collect()} == {"a/target/y.py", "target.py"}


def test_language_full_name_first(spark, files):
    got = {r.path: r.language for r in inv.with_language(files({"Dockerfile": "", "x.dockerfile": "", ".gitignore": "", "q.zzz": ""})).collect()}
    assert got == {"Dockerfile": "Dockerfile", "x.dockerfile": "Dockerfile", ".gitignore": "Git Config", "q.zzz": "Unknown"}


def test_directory_summary_against_brute_force(spark, files):
    import random
    rnd = random.Random(3)
    contents = {f"d{rnd.randrange(30)}/f{i}.{rnd.choice(['py', 'go', 'rs', 'js', 'ts', 'rb', 'c'])}": "" for i in range(400)} | {"r.py": ""}
    rows = inv.inventory(files(contents)).collect()
    want = {}
    for r in sorted(rows, key=lambda r: r.path):
        n, langs = want.setdefault(r.path.split("/")[0] if "/" in r.path else "(root)", [0, []])
        want[r.path.split("/")[0] if "/" in r.path else "(root)"][0] += 1
        if r.language not in langs:
            langs.append(r.language)
    got = inv.directory_summary(inv.inventory(files(contents))).orderBy("rank").collect()
    assert [(r.top_dir, r.files, r.languages) for r in got] == [(d, n, l[:5]) for d, (n, l) in sorted(want.items())[:20]]


def test_scan_reads_only_needed_columns(spark, files, tmp_path):
    files({"a.py": "x"}).withColumn("size", F.lit(1).cast("bigint")).write.parquet(str(tmp_path / "f"))
    plan = inv.inventory(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Exchange" not in plan
