"""The pipeline, stage by stage, against what brute force keeps of a small corpus."""
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_corpora import DOCS, expected_components, expected_lines, expected_targets, prose, words_of

import corpus_pipeline
from codecairn.llm import bpe, line_rules, novelty

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    base = [prose(r.randrange(60, 150), r) for _ in range(25)]
    texts = base + [b + " " + prose(3, r) for b in base[:8]] + base[:4] + ["too short", "", None, "a b c " * 60]
    texts[3] += " token = 'abcdefghijkl0123'"
    rows = [(i, t, None, r.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scans", "source mixing", "bpe encoding"]
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((kept := stage(spark, docs, path)).collect(), kept.schema)
        done[name] = docs.collect()
        assert name == "bpe encoding" or docs.columns == NAMES
    text_of = {r[0]: r[1] for r in rows}
    passed = {e[0] for e in expected_lines([(r[0], r[1], r[3]) for r in rows], line_rules.LINE_DOCS, line_rules.LINE_SHARE, line_rules.LEAST_KEPT) if e[-1]}
    assert {r["doc_id"] for r in done["quality rules"]} == passed and all(r["text"] == text_of[r["doc_id"]] for r in done["quality rules"])
    groups, _ = expected_components([(i, text_of[i]) for i in sorted(passed)])
    assert Counter(r["doc_id"] for r in done["near duplicates"]) == Counter({c for _, _, c in groups})
    assert {(r["doc_id"], r["text"]) for r in done["secret scans"]} == {(c, novelty.masked(text_of[c])) for _, _, c in groups}
    assert any("[secret]" in r["text"] for r in done["secret scans"])
    before, after = {r["doc_id"]: r for r in done["secret scans"]}, Counter(r["doc_id"] for r in done["source mixing"])
    assert set(after) <= set(before) and max(after.values()) <= 3
    assert all(r == before[r["doc_id"]] for r in done["source mixing"])
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, r in before.items():
        n = len(words_of(r["text"]))
        size[r["source"]] += n
        taken[r["source"]] += n * after[i]
        largest[r["source"]] = max(largest[r["source"]], n)
    assert all(abs(taken[s] - t) <= largest[s] for s, t in expected_targets(size).items())
    coder = bpe.Bpe(open(bpe.vocabulary_path(), encoding="utf-8").read())
    want = Counter()
    for r in done["source mixing"]:
        ids = coder.encode(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter(map(tuple, done["bpe encoding"])) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).collect())) == want


def test_quality_removes_common_lines_of_an_ordinary_host(spark):
    r = random.Random(5)
    texts = [prose(30, r) + "\n" + prose(30, r) for _ in range(60)]
    common = "\n".join(f"c{k} all rights{k} reserved{k} by{k} the{k} owner{k} of{k} this{k} page{k}" for k in range(5))
    rows = [(i, t + "\n" + common if i < 12 else t, None, "h", 0) for i, t in enumerate(texts)]
    rows += [(100, common + "\n" + " ".join(f"n{i}" for i in range(20)), None, "h", 0)]
    rows += [(200 + i, texts[50] + "\nrare", None, "copies", 0) for i in range(30)]  # copies of a page are one text
    got = {d["doc_id"]: d["text"] for d in corpus_pipeline.quality(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert 100 not in got and all(got[i] == t for i, t in enumerate(texts))
    assert all(got[200 + i] == texts[50] + "\nrare" for i in range(30))


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
