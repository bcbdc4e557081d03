import io
import random
import warnings
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codecairn.functions import text
from codecairn.operators import inventory, relations
from codecairn.plans import analysis, explanation
from codecairn.sources import archives, artifacts, tree
from codecairn.streaming import streams


def zipped(contents):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in contents.items():
            z.writestr(name, data)
    return b.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(zipped({"src/a.py": "import os", "node_modules/x.js": "x", "../evil": "x", "/abs": "x",
                                               "w\\b.py": b"\xff ok", "d/": ""}))
    (tmp_path / "two.ZIP").write_bytes(b"not a zip")
    members = archives.read_archives(spark, str(tmp_path / "*.[zZ]*"))
    got = {(r.repo_id, r.path, r.content, r.size) for r in archives.files_of(members).collect()}
    assert got == {("one", "src/a.py", "import os", 9), ("one", "w/b.py", "\ufffd ok", 4)}
    assert [(r.repo_id, r.error.split(":")[0]) for r in archives.bad_archives(members).collect()] == [("two", "BadZipFile")]


def test_tree(spark, tmp_path):
    for p, data in {"r1/a/b.py": "x", "r1/build/c.py": "x", "r2/d.md": "yy"}.items():
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(data)
    got = {(r.repo_id, r.path, r.content, r.size) for r in tree.read_tree(spark, str(tmp_path / "root")).collect()}
    assert got == {("r1", "a/b.py", "x", 1), ("r2", "d.md", "yy", 2)}
    small = tree.read_tree(spark, f"file://{tmp_path}/root", max_bytes=1).collect()
    assert {(r.path, r.content, r.size) for r in small} == {("a/b.py", "x", 1), ("d.md", None, 2)}


def test_decode(spark):
    df = spark.createDataFrame([(b"a\xffb",), ("é".encode(),)], "b binary")
    assert [r[0] for r in df.select(text.decode_text(F.col("b"))).collect()] == ["a\ufffdb", "é"]


def test_artifacts(spark, files, tmp_path):
    with pytest.raises(ValueError):
        artifacts.read_artifact(spark, str(tmp_path), "other")
    assert artifacts.read_artifact(spark, str(tmp_path), "tech").count() == 0
    contents = {"src/main.py": 'import os\ntoken = "abcdefgh12"', "package.json": '{"dependencies": {"react": "1"}}', "build/x.py": "import no"}
    analysis.run_analysis(spark, files(contents), str(tmp_path / "out"))
    read = {k: artifacts.read_artifact(spark, str(tmp_path / "out"), k).collect() for k in artifacts.SCHEMAS}
    assert [r.path for r in read["important_files"]] == ["src/main.py"]
    assert [(r.source, r.target) for r in read["relationships"]] == [("src/main.py", "os")]
    assert read["tech"][0].frontend_frameworks == ["React"] and read["secrets_report"][0].files_with_secrets == 1


def test_facts_give_the_same_tables_as_files(spark, files):
    contents = {"a/main.py": "import os\nopenai", "b.js": "fetch('/api/x')\nxo" + "xb-1234567890-abc", "models/m.py": "class M(Base):"}
    direct, facts = analysis.analyse(files(contents)), analysis.analyse(analysis.write_facts(spark, files(contents)))
    for name in ("inventory", "important", "relationships", "tech", "findings", "secrets_report"):
        a, b = getattr(direct, name), getattr(facts, name)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name


def test_explain_end_to_end(spark, files):
    contents = {"models/main.py": "class Item(Base):\nimport os", "requirements.txt": "flask", "README.md": "hi"}
    projects = spark.createDataFrame([("r", "desc", None, "developer")],
                                     "repo_id string, product_description string, important_features string, technical_level string")

    def model(system, prompt):
        if "one section" in system and "Main User Flow" in system:
            return "**Step 1 — run**\n- **File**: `models/main.py`"
        return '{"responsibility": "x"}' if "File path" in prompt else "see models/main.py and ghost/x.py"

    row = explanation.explain(spark, analysis.saved_analysis(spark, files(contents)), projects, model).first()
    assert len(row.sections) == 9 and set(row.diagrams) == {"system_architecture.mmd", "repository_map.mmd", "database_erd.mmd", "main_user_flow.mmd"}
    assert {x.path for x in row.validation_report.unresolved_file_paths} == {"ghost/x.py"}
    assert row.tech_summary["backend_frameworks"] == ["Flask"]


def test_streams_equal_batch(spark, files, tmp_path):
    contents = {f"s/f{i}.py": f"import m{i % 2}\nimport m{i % 2}" for i in range(6)}
    for part in range(2):
        files(contents).filter(F.crc32("path") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.stream_table(spark, str(tmp_path / "in"), max_files_per_batch=1)
    got = streams.run_append(streams.stream_inventory(stream), str(tmp_path / "i"))
    want = inventory.inventory(files(contents))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    timed = stream.withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    once = streams.run_append(streams.stream_relationships(timed.unionByName(timed), "at"), str(tmp_path / "r"))
    assert once.count() == relations.relationships(files(contents)).count() == 6


def test_stream_status_over_batches(spark, tmp_path):
    for rows in ([(1, 1, "extracted", 1), (2, 1, "error", 2)], [(1, 3, "complete", 3)], [(1, 2, "analyzed", 4)]):
        spark.createDataFrame(rows, "project_id int, ts int, status string, event_id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = streams.stream_table(spark, str(tmp_path / "log"), max_files_per_batch=1)
    got = {(r.project_id, r.status) for r in streams.run_latest_status(log, str(tmp_path / "run")).collect()}
    assert got == {(1, "complete"), (2, "error")}


def test_stream_archives(spark, tmp_path):
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "one.zip").write_bytes(zipped({"a.py": "import os"}))
    out = streams.run_append(streams.stream_edges(streams.stream_archives(spark, str(tmp_path / "zips"))), str(tmp_path / "run"))
    assert [(r.repo_id, r.source, r.target) for r in out.collect()] == [("one", "a.py", "os")]


def test_repeated_and_damaged_members(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        z.writestr("a.py", "old")
        z.writestr("bad.py", random.Random(0).randbytes(3000))
        z.writestr("./a.py", "new")
        z.writestr("c.py", "kept")
        at = z.getinfo("bad.py").header_offset + 60
    data = bytearray(buffer.getvalue())
    data[at:at + 40] = b"\xff" * 40
    members = archives.unpack_archives(spark.createDataFrame([("z", "r", bytes(data))], "archive string, repo_id string, content binary"))
    assert {(r.path, r.content) for r in archives.files_of(members).collect()} == {("a.py", "new"), ("c.py", "kept")}
    assert [(r.archive, r.path) for r in archives.bad_archives(members).collect()] == [("z", "bad.py")]


def test_tree_is_cut_at_its_root_only(spark, tmp_path, monkeypatch):
    for place in ("data/r1/src/data/x/a.py", "data/r1/mydata/b.py", "data/r2/data/c.py"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(place)
    got = {(r.repo_id, r.path, r.content) for r in tree.read_tree(spark, str(tmp_path / "data")).collect()}
    assert got == {("r1", "src/data/x/a.py", "data/r1/src/data/x/a.py"), ("r1", "mydata/b.py", "data/r1/mydata/b.py"), ("r2", "data/c.py", "data/r2/data/c.py")}


def test_bad_archives_on_a_stream(spark, tmp_path):
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "one.zip").write_bytes(zipped({"a.py": "import os"}))
    (tmp_path / "zips" / "two.zip").write_bytes(zipped({"a.py": "import os"})[:20])
    bad = streams.run_append(streams.stream_bad_archives(spark, str(tmp_path / "zips")), str(tmp_path / "run"))
    assert [r.repo_id for r in bad.collect()] == ["two"]


def test_wrapped_upload_and_all_findings(spark, files, tmp_path):
    contents = {f"top/src/f{i:02}.py": 'token = "abcdefgh12"' for i in range(12)} | {"top/yarn.lock": "", "top/package.json": '\ufeff{"dependencies": {"react": "1"}}'}
    a = analysis.run_analysis(spark, files(contents), str(tmp_path / "out"))
    assert artifacts.read_artifact(spark, str(tmp_path / "out"), "secret_findings").count() == 12
    assert {r.source for r in a.relationships.collect()} == set() and "src/f00.py" in {r.path for r in a.inventory.collect()}
    row = a.tech.first()
    assert row.frontend_frameworks == ["React"] and row.package_managers == ["Yarn"]


def test_labels_of_runs_are_apart(spark):
    from codecairn.operators import validate
    diagrams = spark.createDataFrame([("r", "1", "d", 'x["ghost"]'), ("r", "2", "d", 'x["main.py"]')], "repo_id string, run_id string, diagram string, text string")
    known = spark.createDataFrame([("r", "src/main.py")], "repo_id string, component string")
    got = validate.unresolved_components(validate.diagram_labels(diagrams), known)
    assert [(r.run_id, r.component) for r in got.collect()] == [("1", "ghost")]


def test_artifacts_are_replaced_by_repository(spark, tmp_path):
    out = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "repo_id string, file string")
    rows = lambda kind="high_risk_files", **k: sorted(map(tuple, artifacts.read_artifact(spark, out, kind, **k).collect()))
    everyone = [(f"r{i}", "old") for i in range(40)]
    assert artifacts.write_artifacts({"high_risk_files": frame(everyone)}, out, buckets=4) == 1
    # r1 has new rows, r2 is analysed again and has none, r99 is new
    analysed = spark.createDataFrame([("r1",), ("r2",)], "repo_id string")
    artifacts.write_artifacts({"high_risk_files": frame([("r1", "new"), ("r1", "more"), ("r99", "new")])}, out, analysed)
    second = sorted([e for e in everyone if e[0] not in ("r1", "r2")] + [("r1", "new"), ("r1", "more"), ("r99", "new")])
    assert rows() == second and rows(version=1) == sorted(everyone)
    # another kind does not touch the first
    artifacts.write_artifacts({"secret_findings": spark.createDataFrame([("r1", "f", ["t"])], artifacts.SCHEMAS["secret_findings"])}, out)
    assert rows() == second and rows("secret_findings") == [("r1", "f", ["t"])]
    # a run that fails leaves what was there
    broken = frame([("r3", "bad")]).select("repo_id", F.raise_error(F.lit("stop")).cast("string").alias("file"))
    with pytest.raises(Exception):
        artifacts.write_artifacts({"high_risk_files": broken}, out, analysed)
    assert rows() == second
    # two runs from one version: the second to publish fails
    old = artifacts.Published
    artifacts.Published = lambda s, d, v=None: old(s, d, 2 if v is None else v)
    try:
        with pytest.raises(Exception):
            artifacts.write_artifacts({"high_risk_files": frame([("r5", "lost")])}, out)
    finally:
        artifacts.Published = old
    assert rows() == second
    artifacts.expire_artifacts(spark, out, keep=1)
    assert rows() == second and not (tmp_path / "store" / "published" / "version=1").exists()
    # everything goes
    artifacts.write_artifacts({"high_risk_files": frame([]), "secret_findings": spark.createDataFrame([], artifacts.SCHEMAS["secret_findings"])}, out,
                              spark.createDataFrame([(r[0],) for r in second], "repo_id string").unionAll(analysed))
    assert rows() == [] and rows("secret_findings") == []


def test_components_by_grams_equal_all_pairs(spark):
    from codecairn.operators import validate
    r = random.Random(9)
    name = lambda n: "".join(r.choice("ab/.") for _ in range(r.randrange(1, n)))
    labels = {(f"r{r.randrange(3)}", name(9)) for _ in range(150)} | {("r0", ""), ("r3", "abc"), ("r1", "x" * 300)}
    known = {(f"r{r.randrange(3)}", name(14)) for _ in range(60)} | {("r1", "x" * 299), ("r0", "zzz")}
    found = validate.contained(spark.createDataFrame(sorted(labels), "repo_id string, label string"),
                               spark.createDataFrame(sorted(known), "repo_id string, component string"))
    assert {tuple(f) for f in found.collect()} == {(a, x) for a, x in labels if any(a == b and (x in y or y in x) for b, y in known)}


def test_saved_plan_and_report(spark, files, tmp_path):
    out = str(tmp_path / "out")
    projects = spark.createDataFrame([("r", "d", None, None)], "repo_id string, product_description string, important_features string, technical_level string")
    a = analysis.saved_analysis(spark, files({"main.py": "import os"}))
    payload = explanation.explain(spark, a, projects, lambda s, p: "see ghost/x.py", directory=out).first()
    plan, report = artifacts.read_artifact(spark, out, "plan").first(), artifacts.read_artifact(spark, out, "validation_report").first()
    assert plan.repo_id == "r" and plan.main_user_flow_target
    assert report.unresolved_file_paths == payload.validation_report.unresolved_file_paths != []


def test_members_by_range_equal_whole_archives(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    r = random.Random(1)
    for k, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(folder / f"m{k}.zip", "w", method) as z, warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for i in range(40):
                z.writestr(f"src/f{i:02}.py", "import os\n" * r.randrange(0, 400))
            z.writestr("node_modules/x.js", "x")
            z.writestr("src/./f00.py", "again")
            z.writestr("d/", "")
            with z.open("big/zip64.py", "w", force_zip64=True) as f:
                f.write(b"import zip64\n" * 9)
    damaged = bytearray((folder / "m1.zip").read_bytes())
    with zipfile.ZipFile(io.BytesIO(bytes(damaged))) as z:
        info = z.getinfo("src/f07.py")
    damaged[info.header_offset + 30 + len(info.filename)] ^= 0xFF
    (folder / "m3.zip").write_bytes(bytes(damaged))
    (folder / "m4.zip").write_bytes(bytes(damaged[:500]))
    (folder / "m5.zip").write_bytes(b"")  # Spark reads no empty files
    data = bytearray((folder / "m0.zip").read_bytes())
    data[data.rindex(b"PK\x01\x02") + 8] |= 1  # the last member is marked as encrypted
    (folder / "m6.zip").write_bytes(bytes(data))
    whole = archives.read_archives(spark, str(folder / "*.zip"))
    ranged = archives.read_archives_by_range(spark, str(folder / "*.zip"), range_bytes=1000)
    rows = lambda df: sorted(map(tuple, archives.files_of(df).collect()))
    assert rows(ranged) == rows(whole) and len(rows(whole)) > 150
    bad = lambda df: sorted((b.repo_id, b.path or "") for b in archives.bad_archives(df).collect())
    assert bad(ranged) == bad(whole) == [("m3", "src/f07.py"), ("m4", ""), ("m6", "big/zip64.py")]


def test_text_is_read_without_an_exchange_whether_wrapped_or_not(spark, files):
    plan = analysis.file_facts(files({"top/a.py": "import os"}), maybe_wrapped=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_wrapped_facts_equal_those_of_stripped_files(spark, files):
    inside = {"main.py": "import os\nopenai", "web/pages/x.js": "fetch('/api/x')", "build/y.py": "import no", "README.md": "hi", "api/auth/z.ts": "import a from 'a'",
              "package.json": "{}", "models/m.py": "class M(Base):", "src/build/q.py": "import hidden", "other.txt": "token = 'abcdefghij'"}
    for wrapper in ("top", "build", "src", "vendor"):
        wrapped = files({f"{wrapper}/{p}": c for p, c in inside.items()}).unionByName(files(inside, repo="plain"))
        want = analysis.file_facts(inventory.strip_repo_root(wrapped))
        got = analysis.write_facts(spark, wrapped, strip_root=True)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())), wrapper


def test_replayed_batches_change_nothing(spark, tmp_path):
    from pyspark.sql.streaming.readwriter import DataStreamWriter
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int, v string")
    calls = []
    real = DataStreamWriter.foreachBatch

    def twice(self, func):
        def run(batch, batch_id):
            func(batch, batch_id)
            func(batch, batch_id)
            calls.append(batch_id)
        return real(self, run)

    DataStreamWriter.foreachBatch = twice
    try:
        folder, run = str(tmp_path / "in"), str(tmp_path / "run")
        for part in (rows((1, 1, "a"), (2, 5, "b"), (3, 1, "c")), rows((1, 3, "d"), (2, 4, "late"), (4, 1, "e")), rows((3, 1, "c")), rows((1, 9, None))):
            part.coalesce(1).write.mode("append").parquet(folder)
            got = streams.run_current(streams.stream_table(spark, folder), ["k"], ["at"], run, buckets=3)
        assert sorted(map(tuple, got.collect())) == [(1, 9, None), (2, 5, "b"), (3, 1, "c"), (4, 1, "e")]
        assert len(calls) >= 4 and len(list((tmp_path / "run" / "published").iterdir())) == 2  # older versions are gone
        zips = spark.createDataFrame([("one", "one", bytearray(zipped({"a.py": "import os"}))), ("two", "two", bytearray(b"no"))], "archive string, repo_id string, content binary")
        zips.coalesce(1).write.parquet(str(tmp_path / "zips"))
        arrived = streams.run_archives(streams.stream_table(spark, str(tmp_path / "zips")), str(tmp_path / "arrivals"))
        assert [r.path for r in arrived.files.collect()] == ["a.py"] and [r.repo_id for r in arrived.errors.collect()] == ["two"]
        assert relations.relationships(arrived.facts).count() == 1
    finally:
        DataStreamWriter.foreachBatch = real


def test_edge_changes_over_batches(spark, files, tmp_path):
    at = lambda df, t: df.withColumn("at", F.timestamp_seconds(F.lit(t)))
    py = lambda **texts: files({f"{n}.py": c for n, c in texts.items()})
    batches = [at(py(a="import x\nimport y", b="import z"), 10), at(py(a="import y\nimport w", b="import z"), 20), at(py(a="import late", b="import also"), 15),
               at(py(b=""), 30).unionByName(at(py(b="import twice"), 29))]
    seen = []
    for rows in batches:
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        changes = streams.run_append(streams.stream_edge_changes(streams.stream_table(spark, str(tmp_path / "in")), "at"), str(tmp_path / "run"))
        seen.append(changes.count())
    assert seen == [3, 5, 5, 6]
    assert sorted((r.source, r.target) for r in streams.current_edges(changes).collect()) == [("a.py", "w"), ("a.py", "y")]


def test_many_small_files_of_a_tree_are_few_tasks(spark, tmp_path):
    root = tmp_path / "a b%20é"
    for k in range(240):
        f = root / f"r{k % 12}" / f"d{k % 5}" / f"f{k}.txt"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * (k + 1))
    for p, data in {"r1/a%2Fb c/é#?.py": "é", "r1/empty.py": "", "r1/.git/x.py": "x", "r1/.env": "x", "r1/_x/y.py": "x", "r1/_k=v/z.py": "z",
                    "r1/p._COPYING_": "x", "_r=2/a.py": "2", ".r3/a.py": "x", "above.py": "x", "r1/deep/er/and/er/q.py": "q"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(data)
    (root / "no files").mkdir()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")  # two files to a task of the source, at 4 MB for opening each
    try:
        read = tree.read_tree(spark, str(root))
        assert read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        whole = spark._jvm.org.apache.hadoop.fs.Path(str(root)).toString()
        source = tree._by_source(spark, str(root), f"file:{whole}/", 100)
        tasks = tree._by_tasks(spark, spark._jvm.java.io.File(str(root)).toURI().toASCIIString().replace("file:/", "file:///", 1).rstrip("/"), 100)
        rows = lambda df: sorted((r.inside, r.length, r.content and bytes(r.content)) for r in df.collect())
        assert rows(tasks) == [r for r in rows(source) if "/" in r[0]] and len(rows(tasks)) == 244
        assert sum(r[2] is None for r in rows(tasks)) == 140
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "read(" not in read.select("path")._jdf.queryExecution().optimizedPlan().toString()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert tree.read_tree(spark, str(empty)).collect() == []


def test_small_archives_are_listed_by_few_tasks(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    for k in range(120):
        (folder / f"z{k:03}.zip").write_bytes(zipped({"a.py": f"import m{k}"}))
    (folder / "bad.zip").write_bytes(b"no")
    before, scratch = spark.conf.get("spark.sql.files.maxPartitionBytes"), Path(spark.conf.get("spark.checkpoint.dir"))
    lists = set(scratch.glob("members-*"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # an archive to a task, at 4 MB for opening each
    try:
        members = archives.read_archives_by_range(spark, str(folder / "*.zip"))
        assert sorted(r.content for r in archives.files_of(members).collect()) == sorted(f"import m{k}" for k in range(120))
        assert [b.repo_id for b in archives.bad_archives(members).collect()] == ["bad"]
        listing = [f for new in set(scratch.glob("members-*")) - lists for f in new.glob("part-*")]
        assert 0 < len(listing) <= archives.LISTING_TASKS * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_archives_of_a_batch_are_taken_out_one_at_a_time():
    import tracemalloc

    import pyarrow as pa
    data = random.Random(3).randbytes(500_000)
    good = zipped({"a.bin": data, "node_modules/b.js": data})
    rows = [*((f"z{k}", f"r{k}", good) for k in range(80)), ("cut", "cut", good[:99]), ("none", "none", None), (None, None, good)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], ["archive", "repo_id", "content"])
    tracemalloc.start()
    sizes = [(b.num_rows, b.column("error").null_count) for b in archives._unpack(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in sizes) == 83 and sum(n - good for n, good in sizes) == 2
    assert peak < 40 << 20 < batch.nbytes  # what is handed over at a time, not the batch once more
