from codecairn.operators import relations as rel

# Golden values: relationship, target and evidence line of one analysed sample project.
GOLDEN_LINES = [
    ("imports", "../server/server", "const app = require('../server/server');"),
    ("imports", "../middleware/authMiddleware", "router.get('/me', require('../middleware/authMiddleware'), async (req, res) => {"),
    ("imports", "react-router-dom", "import { BrowserRouter as Router, Routes, Route, Navigate } from 'react-router-dom';"),
    ("imports", "react", "import React from 'react'"),
    ("declares_route", "GET /me", "router.get('/me', require('../middleware/authMiddleware'), async (req, res) => {"),
    ("declares_route", "POST /register", "router.post('/register', async (req, res) => {"),
    ("declares_route", "DELETE /:id", "router.delete('/:id', auth, async (req, res) => {"),
    ("calls_api", "/api/auth/me", "axios.get('/api/auth/me').catch(() => {"),
    ("calls_api", "/api/tasks/${id}", "const res = await axios.put(`/api/tasks/${id}`, rest)"),
    ("calls_api", "/api/users/${userId}", "await axios.delete(`/api/users/${userId}`)"),
]


def edges(df):
    return [(r.relationship, r.target) for r in df.orderBy("extractor", "line", "pos").collect()]


def test_golden_lines(spark, files):
    found = rel.relationships(files({f"f{i}.js": line for i, (_, _, line) in enumerate(GOLDEN_LINES)})).collect()
    got = {(r.source, r.relationship, r.target, r.evidence) for r in found}
    assert {(f"f{i}.js", *golden) for i, golden in enumerate(GOLDEN_LINES)} <= got


def test_python_import_stays_on_its_line(spark, files):
    got = edges(rel.py_imports(files({"a.py": "import a, b as c\nfrom d import e\n  import hidden\nimport os  # note"})))
    assert got == [("imports", t) for t in ("a", "b", "d", "os")]


def test_call_over_lines_has_its_first_line_as_evidence(spark, files):
    got = rel.js_routes(files({"a.ts": "app\n  .get(\n  '/x', h)\nwebapp.get('/no')"})).collect()
    assert [(r.target, r.evidence) for r in got] == [("GET /x", "app")]


def test_f_string_and_bare_name(spark, files):
    src = "requests.get(f'https://a/{x}')\nrequests.get(foo_url)\nrequests.post('ab')"
    assert edges(rel.py_requests_calls(files({"a.py": src}))) == [("calls_api", "https://a/{x}")]


def test_word_boundaries(spark, files):
    assert edges(rel.js_http_calls(files({"a.js": "prefetch('/no')\nfetch('/yes')"}))) == [("calls_api", "/yes")]
    assert edges(rel.django_urls(files({"a.py": "xpath('no')\nre_path(r'^yes$')"}))) == [("declares_route", "URL ^yes$")]


def test_first_edge_per_target_is_kept(spark, files):
    src = "app.get('/x', a)\n\napp.get('/x', b)\nimport z from 'z'\nconst q = require('z')"
    got = rel.relationships(files({"a.js": src})).orderBy("extractor").collect()
    assert [(r.target, r.line, r.evidence) for r in got] == [("z", 4, "import z from 'z'"), ("GET /x", 1, "app.get('/x', a)")]


def test_in_row_dedupe_equals_grouped_dedupe(spark, files):
    src = {f"p{i}.py": "\n".join(f"import m{j % 3}\nfrom n{j % 2} import x\nsession.add(1)" for j in range(i + 1)) for i in range(8)}
    a = rel.relationships(files(src)).collect()
    b = rel.dedupe_relationships(rel.extract(files(src), list(rel.EXTRACTORS))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_relationships_needs_no_shuffle(spark, files, tmp_path):
    files({"a.py": "import os"}).write.parquet(str(tmp_path / "f"))
    plan = rel.relationships(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_evidence_is_trimmed_and_cut(spark, files):
    r = rel.py_imports(files({"a.py": "import os  #" + "x" * 400})).first()
    assert len(r.evidence) == 200 and r.evidence.startswith("import os")


def test_orm_usage(spark, files):
    got = edges(rel.orm_usage(files({"a.py": "db.session.commit()\nsession.query(User)\nBase.metadata.create_all()"})))
    assert got == [("uses_model", t) for t in ("db.session.", "session.query", "Base.metadata")]


def test_external_apis_and_limits(spark, files):
    src = "\n".join(f"fetch('/api/{i:03}')" for i in range(70)) + "\nfetch('/other')\nfetch('https://h/x')"
    e = rel.relationships(files({"a.js": src}))
    got = [r.target for r in rel.external_apis(e).orderBy("rank").collect()]
    assert got == [f"/api/{i:03}" for i in range(50)]
    assert rel.relationships_of(e, "calls_api", 20).count() == 20


def test_calls_over_lines_keep_the_lines_of_the_file(files):
    py = ("# see (\n"
          "import os\n"
          "s = '('\n"
          "from x import (a)\n"
          "requests.get(\n"
          "\n"
          "    'https://a.example.com/v1')\n"
          "import after\n"
          "@app\n"
          "  .post(\n"
          "  '/p')\n"
          "y = requests.get('https://b.example.com'); z = requests.get(\n"
          "'https://c.example.com')\n")
    js = ("// fetch(\n"
          "import a from 'a'\n"
          "await axios\n"
          "  .put(\n"
          "`/api/x`, b)\n"
          "const c = require(\n'c')\n"
          "t = \"app.get(\"\n"
          "router\n\n\n.get('/r', h)\n"
          "import {\n  d\n} from 'd'\n")
    got = {(r.source, r.relationship, r.target, r.line, r.evidence) for r in rel.relationships(files({"m.py": py, "m.js": js})).collect()}
    assert got == {
        ("m.py", "imports", "os", 2, "import os"), ("m.py", "imports", "x", 4, "from x import (a)"),
        ("m.py", "calls_api", "https://a.example.com/v1", 5, "requests.get("), ("m.py", "imports", "after", 8, "import after"),
        ("m.py", "declares_route", "POST /p", 9, "@app"),
        ("m.py", "calls_api", "https://b.example.com", 12, "y = requests.get('https://b.example.com'); z = requests.get("),
        ("m.py", "calls_api", "https://c.example.com", 12, "y = requests.get('https://b.example.com'); z = requests.get("),
        ("m.js", "imports", "a", 2, "import a from 'a'"), ("m.js", "calls_api", "/api/x", 3, "await axios"),
        ("m.js", "imports", "c", 6, "const c = require("), ("m.js", "declares_route", "GET /r", 9, "router")}


def test_long_files_are_matched_once_per_line(files):
    content = "\n".join(f"import m{i}\nrequests.get(\n'https://h{i}.example.com/x')" for i in range(3000))
    rows = rel.relationships(files({"a.py": content}))
    assert rows.count() == 6000 and rows.agg({"line": "max"}).first()[0] == 8999
