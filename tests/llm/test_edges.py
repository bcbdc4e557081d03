"""Very long texts, nulls, repeated rows and columns with the names that operators use inside, for all operators on documents."""
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_corpora import DOCS, expected_components, expected_lines, expected_without_repeats, prose, words_of

import corpus_pipeline
from codecairn.llm import bpe, jaccard, langid, licenses, line_rules, mixing, novelty, rollups, substrings

CLASH = ("_node", "_key", "_text_key", "_removed", "_alone", "_stays", "node", "key", "row", "root", "host", "line", "lines", "words", "pivot", "low", "high",
         "size", "copies", "rank", "digest", "part", "shard", "feature", "at", "x", "y", "draw", "k", "held_out", "score", "taken", "spans", "n_words", "kept")
R = random.Random(17)
LONG = prose(45_000, R) + "\npassword = 'abcdefghij0123456789'\n" + prose(15_000, R)
ROWS = [(1, LONG, "a"), (2, LONG + " " + prose(900, R), "a"), (3, prose(80, R), None), (3, prose(80, R), None), (4, None, "a"), (5, "", None), (None, None, None),
        (None, prose(70, R), "b"), (7, LONG, "b"), (7, LONG, "b"), (8, "x" * 200_000, "b"), (9, " " * 50_000 + "y", "b"), (10, "\n" * 10_000, None)]
ROWS += [ROWS[2], ROWS[7]]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, None, s, None if t is None else len(t)) for i, t, s in ROWS]
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_line_rules(docs):
    got = line_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = expected_lines(ROWS, line_rules.LINE_DOCS, line_rules.LINE_SHARE, line_rules.LEAST_KEPT)
    assert Counter(map(tuple, got)) == Counter(want)
    clean = line_rules.clean(docs)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(w[0] for w in want if w[-1])


def test_substrings(docs):
    got = substrings.without_repeats(docs).collect()
    assert Counter((g["doc_id"], g["n_words"], g["n_removed"], g["kept"]) for g in got) == Counter(expected_without_repeats([r[:2] for r in ROWS]))


def test_jaccard(docs):
    rows = [r[:2] for r in ROWS]
    want, top = expected_components(rows)
    assert Counter(map(tuple, jaccard.near_duplicates(docs).collect())) == Counter(want)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(top))


def test_mixing(docs):
    got = mixing.mixed(docs).collect()
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((i, len(words_of(t))) for i, t, _ in ROWS)
    assert all(0 <= g["taken"] <= 3 * g["size"] for g in got)
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns and {r["text"] for r in mix.collect()} <= {t for _, t, _ in ROWS}


def test_novelty(docs):
    masked = novelty.mask(docs)
    texts = {(r["doc_id"], r["text"]) for r in masked.collect()}
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert not any("abcdefghij0123456789" in (t or "") for _, t in texts) and {(i, t) for i, t, _ in ROWS if not t or len(t) < 1000} <= texts


def test_language_and_licences_and_rollups(spark, docs, tmp_path):
    labelled = docs.withColumn("lang", F.lit("xx"))
    assert Counter(r["doc_id"] for r in langid.predict(labelled, langid.train(labelled)).collect()) == Counter(r[0] for r in ROWS)
    found = licenses.scan(docs, licenses.known_licences(spark)).collect()
    assert len(found) == len(ROWS) and all((r["digest"] is None) or len(r["digest"]) == 64 for r in found)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rollups.commit(docs.select(rollups.no_image().alias("before"), rollups.image("1", words).alias("after"), *CLASH[:4]), str(tmp_path / "s"), 0)
    assert sum(r["docs"] for r in rollups.totals(spark, str(tmp_path / "s")).collect()) == len(ROWS)
    assert sum(r["tokens"] for r in rollups.totals(spark, str(tmp_path / "s")).collect()) == sum(len(words_of(t)) for _, t, _ in ROWS)


def test_bpe(docs):
    got = bpe.token_digests(docs.filter("doc_id in (1, 4, 5, 9)"), bpe.vocabulary_path()).collect()
    assert Counter((g["doc_id"], g["decoded_sha256"]) for g in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS if i in (1, 4, 5, 9))


def test_pipeline(spark, docs):
    rows = docs.filter("doc_id is null or doc_id <> 8")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame((out := stage(spark, rows, "")).collect(), out.schema)
        assert rows.columns == docs.columns, name
    ids = {r["doc_id"] for r in rows.collect()}
    assert ids <= {1, 3, None} and corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == rows.count()
