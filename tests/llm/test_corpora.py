"""Operators on relations between documents, against brute force, and their edge cases."""
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from codecairn.llm import components, jaccard, line_rules, mixing, neighbours, rollups, substrings
from codecairn.llm.fm_index import FmIndex, suffix_array

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
R = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def table_of(spark, rows):
    """Rows of (doc_id, text[, source])."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def corpus():
    """Copies, near copies, shared passages, short, empty, null and repeated rows, in mixed cases and spaces."""
    r = random.Random(2)
    base = [prose(r.randrange(30, 200), r) for _ in range(12)]
    passage = prose(40, r)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):
        words = r.choice(base).split()
        for _ in range(r.randrange(0, 6)):
            words[r.randrange(len(words))] = r.choice(VOCABULARY)
        rows.append((100 + i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words) if i % 5 == 0 else " ".join(words)))
    for i in range(30):
        rows.append((200 + i, prose(r.randrange(0, 60), r) + " " + passage + "\t" + prose(r.randrange(0, 60), r)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "two words"), (304, "Two  words"), (305, "two words more"), (306, passage),
             (306, passage), (7, base[3]), (None, base[4]), (None, passage), (310, "é " * 30), (311, "a " * 30), (312, "a " * 29), (-5, base[5])]
    return rows


def words_of(text):
    return (text or "").encode().split()


# --- repeated passages ----------------------------------------------------------------------

def expected_without_repeats(rows, size=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k:k + size])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((i, len(w), sum(gone), kept))
    return out


@pytest.mark.parametrize("hot, shard, flush", [(20_000, 1_500_000, 8 << 20), (2, 300, 500)])
def test_substrings_equal_brute_force(spark, monkeypatch, hot, shard, flush):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    rows = corpus()
    docs = table_of(spark, rows).withColumn("n_words", F.lit("clash")).repartition(5)
    got = substrings.without_repeats(docs).collect()
    assert Counter((g["doc_id"], g["n_words"], g["n_removed"], g["kept"]) for g in got) == Counter(expected_without_repeats(rows))
    for g in got:
        assert sum(s["end"] - s["start"] for s in g["spans"]) == g["n_removed"]
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_fm_index():
    r = random.Random(1)
    symbols = np.array([r.randrange(1, 4) if k % 9 else 0 for k in range(1, 181)] + [0])
    order = suffix_array(symbols)
    ends = iter(range(10 ** 9))
    text = [(0, next(ends)) if s == 0 else (1, int(s)) for s in symbols]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:i + 20])
    index = FmIndex(symbols)
    places = [k for k in range(8, len(symbols)) if 0 not in symbols[k - 4:k + 1]]
    length, low, high = index.matching_statistics(np.array(places), symbols, 5)
    for p, n, lo, hi in zip(places, length, low, high):
        def count(m):
            return sum(symbols[k:k + m].tolist() == symbols[p - m + 1:p + 1].tolist() for k in range(len(symbols) - m + 1))
        assert n == max(m for m in range(6) if m == 0 or count(m) > 1) and (n == 0 or hi - lo == count(n))
        assert all(symbols[s:s + n].tolist() == symbols[p - n + 1:p + 1].tolist() for s in index.suffixes[lo:hi])


# --- near-duplicates --------------------------------------------------------------------------

def shingles(text):
    w = words_of((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups_of(n, linked):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[top(a)] = top(b)
    return [top(k) for k in range(n)]


def expected_components(rows):
    sets = [shingles(t) for _, t in rows]
    top = groups_of(len(rows), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and bool(sets[b]))
    ids = defaultdict(list)
    for (i, _), t in zip(rows, top):
        ids[t].append(i)
    return [(i, len(s), min((x for x in ids[t] if x is not None), default=None)) for (i, _), s, t in zip(rows, sets, top)], top


@pytest.mark.parametrize("cell, late, block", [(64, 200_000, 500), (2, 0, 3), (2, 50, 10)])
def test_jaccard_equals_brute_force(spark, monkeypatch, cell, late, block):
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "LATE_KEYS", late)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    got = jaccard.near_duplicates(table_of(spark, rows).withColumn("node", F.lit("clash")).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(expected_components(rows)[0])


def test_jaccard_joins_a_region_again_only_where_pairs_were_left(spark, monkeypatch):
    r = random.Random(8)
    passage = prose(40, r)
    rows = [(i, passage + " " + prose(20, r)) for i in range(30)] + [(100 + i, prose(60, r)) for i in range(30)]
    rows += [(200 + i, t + " more") for i, t in rows[40:50]]
    seen, joined = [], jaccard.joined
    monkeypatch.setattr(jaccard, "joined", lambda left, *a: seen.append(left.count()) or joined(left, *a))
    got = jaccard.near_duplicates(table_of(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(expected_components(rows)[0])
    assert seen[0] >= 30 and sum(seen[1:]) == 0


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_jaccard_reads_the_wanted_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT", sent)
    rows = corpus()
    docs = table_of(spark, rows)
    profile = {p["node"]: (p["code"], p["n_shingles"]) for p in jaccard.profiles(docs).collect() if p["n_shingles"]}
    some = sorted(profile)[::5]
    wanted = spark.createDataFrame([(node, profile[node][0]) for node in some], "node bigint, code bigint")
    texts = {t["node"]: zstandard.ZstdDecompressor().decompress(t["packed"]).decode() for t in jaccard.texts_of(docs, wanted).collect()}
    assert sorted(texts) == some and all(len(shingles(t)) == profile[node][1] for node, t in texts.items())


def test_jaccard_linked_documents_share_enough_of_their_prefixes(spark):
    r = np.random.default_rng(10)
    least = [1 + -(-3 * n // 4) // 8 for n in range(1, 400)]
    sizes = spark.createDataFrame([(n,) for n in range(1, 400)], "n bigint")
    assert [x[0] for x in sizes.orderBy("n").select(jaccard.least_shared(F.col("n"))).collect()] == least
    for n in range(1, 400):
        x = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64))
        for extra in (0, n // 8, n // 3):
            gone = min((n - 3 * (n + extra) // 4 - 1), n // 4)
            for y in (np.concatenate([x, r.integers(0, 1 << 63, extra).astype(np.uint64)]), r.choice(x, n - max(0, gone), replace=False)):
                y, late = np.sort(y), np.sort(r.choice(x, n // 3, replace=False))
                common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
                if 100 * common >= 75 * union:
                    shared = len(np.intersect1d(jaccard.prefix(x, late), jaccard.prefix(y, late)))
                    assert shared >= max(least[len(x) - 1], least[len(y) - 1] if len(y) < 400 else 0)


def test_jaccard_regions_of_many_batches(spark, monkeypatch):
    r = random.Random(9)
    base = [[r.randrange(1 << 64) for _ in range(r.choice((20, 30, 70)))] for _ in range(100)]
    sets = [np.unique(np.array(r.choice(base) + [r.randrange(1 << 64) for _ in range(r.randrange(1, 9))], np.uint64)) for _ in range(1300)]
    low = [r.choice((0.0, 0.2, 0.6)) for _ in sets]
    high = [x if x else 1.0 for x in low]
    root = [r.choice((k, 0)) for k in range(len(sets))]
    members = [(p, k, low[k], high[k], root[k]) for p, ks in ((5, range(1200)), (6, range(1100, 1300)), (7, range(3))) for k in ks]
    left = spark.createDataFrame(members, "pivot bigint, node bigint, low double, high double, root bigint")
    nodes = spark.createDataFrame([(k, len(x), jaccard.sketch(x)) for k, x in enumerate(sets)], "node bigint, n_shingles bigint, sketch binary")
    bits = [jaccard.sketch(x) for x in sets]
    near = defaultdict(dict)  # region: pair -> least difference
    for p in (5, 6, 7):
        own = [m[1] for m in members if m[0] == p]
        largest = max(Counter(root[k] for k in own).items(), key=lambda c: c[::-1])[0]
        for x, y in ((x, y) for x in own for y in own if root[x] != root[y] and root[x] != largest):
            m, n = len(sets[x]), len(sets[y])
            if 4 * min(m, n) >= 3 * max(m, n) and low[x] <= high[y] + 0.25 and low[y] <= high[x] + 0.25:
                if 7 * (differ := jaccard.least_difference(bits[x], bits[y])) <= m + n:
                    near[p][x, y] = differ
    assert len(near[5]) > 1200 and len(near[6]) < 200
    for block in (5000, 400):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        every = {tuple(sorted(m)) for m in jaccard.joined(left, nodes).collect()}
        assert every == {tuple(sorted(m)) for p in near for m in near[p]}
    monkeypatch.setattr(jaccard, "BLOCK", 5000)
    got = [tuple(m) for m in jaccard.joined(left, nodes, True).collect()]
    first = {}
    for (x, y), differ in near[5].items():
        first[x, root[y]] = min(first.get((x, root[y]), (differ, y)), (differ, y))
    assert [p for p, y in got if y is None] == [5]
    assert {tuple(sorted(m)) for m in got if m[1] is not None} == {tuple(sorted(m)) for m in [*near[6], *near[7], *((x, y) for (x, _), (_, y) in first.items())]}


def test_jaccard_empty_and_representatives(spark):
    rows = corpus()
    docs = table_of(spark, rows)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0 and jaccard.representatives(docs.limit(0)).count() == 0
    kept = jaccard.representatives(docs.repartition(4))
    assert kept.columns == docs.columns
    _, top = expected_components(rows)
    ids = defaultdict(list)
    for (i, _), t in zip(rows, top):
        ids[t].append(i)
    want = [min(g, key=lambda i: (i is None, i or 0)) for g in ids.values()]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(0)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    for n, m in ((5, 7), (400, 500), (30, 2500), (1200, 1200)):
        a, b = np.unique(r.choice(pool, n)), np.unique(r.choice(pool, m))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-1, -2), (-2, -3), (-3, -1), (5, 4), (7, 7)]
    got = defaultdict(set)
    for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect():
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted([list(range(61)), list(range(1000, 1050)), [-3, -2, -1]])
    assert all(root in nodes for root, nodes in got.items())
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((20, 16))
    vectors = [(c + 0.12 * r.standard_normal(16)).tolist() for c in centres for _ in range(6)] + r.standard_normal((80, 16)).tolist()
    vectors += [vectors[0], [2 * x for x in vectors[1]], [-x for x in vectors[2]]]
    rows = [(i * 3 + 1, v) for i, v in enumerate(vectors)] + [(4, vectors[5]), (None, vectors[6])]
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15), (9004, [float("inf")] + [1.0] * 15), (9005, [])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("copies", F.lit("clash"))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    top = groups_of(len(rows), lambda a, b: near[a, b])
    ids = defaultdict(list)
    for (i, _), t in zip(rows, top):
        ids[t].append(i)
    want = []
    for k, ((i, _), t) in enumerate(zip(rows, top)):
        least = min((j for j in ids[t] if j is not None), default=None)
        want.append((i, int(near[k].sum()) - 1, least, i is None or i == least))
    want += [(i, 0, i, True) for i, _ in bad]
    assert Counter(map(tuple, neighbours.near_duplicates(df).collect())) == Counter(want)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_neighbours_find_pairs_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_PARTITION", 60)
    r = np.random.default_rng(6)
    rows = [(i, (c + 0.1 * r.standard_normal(8)).tolist()) for i, c in enumerate(np.repeat(r.standard_normal((30, 8)), 5, axis=0))]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {g["vec_id"]: g["n_links"] for g in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert sum(got.values()) >= 0.99 * links.sum() and all(got[i] <= links[i] for i in got)


def test_neighbours_of_a_group_larger_than_window_and_partition(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_PARTITION", 60)
    r = np.random.default_rng(7)
    centre = r.standard_normal(16)
    rows = [(i, (centre + 0.02 * r.standard_normal(16)).tolist()) for i in range(250)] + [(1000 + i, r.standard_normal(16).tolist()) for i in range(30)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert (links[:250] >= 249).all()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {g["vec_id"]: g["n_links"] for g in neighbours.near_duplicates(df, passes=1, window=16).collect()}
    assert all(got[i] == links[k] for k, (i, _) in enumerate(rows[:250]))


def test_neighbours_passes_follow_the_number_of_vectors():
    assert neighbours.passes_for(0) == neighbours.passes_for(2000) == neighbours.PASSES
    assert neighbours.PASSES < neighbours.passes_for(500_000) < neighbours.passes_for(50_000_000)


# --- line rules ----------------------------------------------------------------------------------

def expected_lines(rows, limit, share, least_kept):
    def norm(line):
        return " ".join(line.lower().replace("\x0b", " ").split())
    texts, hosts = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        if t is not None:
            hosts[host].add(t)
            for line in t.split("\n"):
                if line.split():
                    texts[host, norm(line)].add(t)
    out = []
    for i, t, host in rows:
        w = words_of(t)
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        again = {k + d for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = (t or "").split("\n")
        dup = sum(1 for k, line in enumerate(lines) if line.split() and line in lines[:k])
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        gone = sum(len(line.split()) for line in lines if line.split() and
                   len(texts[host, norm(line)]) > max(limit, math.ceil(len(hosts[host]) * share)))
        out.append((i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(again), failed,
                    not failed and len(w) - gone >= len(w) * least_kept))
    return out


def line_corpus():
    r = random.Random(8)
    rows = []
    for i in range(40):
        lines = [prose(r.randrange(5, 12), r) for _ in range(8)]
        lines[2] = "Common  LINE of the host" if i % 2 else "common line of the host"
        if i % 5 == 0:
            lines = [prose(6, r)] + ["this line and the next fill most of the page"] * 3 + ["and so the document has little of its own, " * 3] * 2 + lines[:2]
        rows.append((i, "\n".join(lines), ["a", "b", None][i % 3]))
    rows += [(50, None, "a"), (51, "", "a"), (52, "x y z " * 40, "b"), (53, "é#*$ <b> | & %\n" * 30, "b"), (None, rows[1][1], "b"), (1, rows[1][1], "b")]
    return rows


@pytest.mark.parametrize("limit, share", [(4, 0.0), (4, 0.5), (100, 0.002)])
def test_line_rules_equal_brute_force(spark, limit, share):
    rows = line_corpus()
    docs = table_of(spark, rows).withColumn("host", F.lit("clash")).repartition(3)
    got = line_rules.judged(docs, limit, share).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(expected_lines(rows, limit, share, line_rules.LEAST_KEPT))
    assert line_rules.judged(docs.limit(0)).count() == 0


def test_line_rules_clean(spark):
    rows = line_corpus()
    docs = table_of(spark, rows)
    clean = line_rules.clean(docs, line_docs=4, share=0.0)
    want = Counter(r[0] for r in expected_lines(rows, 4, 0.0, line_rules.LEAST_KEPT) if r[-1])
    got = clean.collect()
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in got) == want
    text_of = {i: t for i, t, _ in rows}
    for r in got:
        assert "common line" not in r["text"].lower() and r["n_chars"] == len(r["text"])
        assert set(r["text"].split("\n")) <= set(text_of[r["doc_id"]].split("\n")) or r["doc_id"] is None


@pytest.mark.parametrize("sent", [200_000, 1])
def test_line_rules_clean_by_row_and_host(spark, monkeypatch, sent):
    """One doc_id and text in two hosts, in one of which a line is common; columns named like the inner ones."""
    monkeypatch.setattr(line_rules, "SENT_LINES", sent)
    r = random.Random(3)
    page = prose(60, r) + "\nthe usual line"
    rows = [(0, page, "a"), (0, page, "b"), (1, "own " * 3 + "\n" + "the usual line\n" * 30 + prose(50, r), None)]
    rows += [(10 + i, prose(60, r) + "\nthe usual line", "a") for i in range(9)] + [(30 + i, prose(60, r) + "\nanother one", "c") for i in range(9)]
    docs = table_of(spark, rows).withColumns({c: F.lit("clash") for c in ("_text_key", "_removed", "host", "line", "lines")}).repartition(4)
    got = Counter((g["doc_id"], g["source"], g["text"]) for g in line_rules.clean(docs, line_docs=5, share=0.0).collect())
    want = Counter((i, s, t.replace("\nthe usual line", "") if s == "a" else t.replace("\nanother one", "")) for i, t, s in rows if i != 1)
    assert {k: v for k, v in got.items() if k[0] != 1} == want
    assert line_rules.clean(docs.limit(0)).count() == 0


def test_line_rules_default_limits_decide(spark):
    """With the limits of the query a line of a host goes, and a document that has little else."""
    r = random.Random(4)
    common = "\n".join(" ".join(f"c{k}{j}" for j in range(12)) for k in range(6))
    rows = [(i, prose(70, r) + "\n" + common, "h") for i in range(20)] + [(50, common + "\nand a few of its own", "h")]
    got = {g["doc_id"]: (g["kept"], g["removed_words"], g["base_failed"]) for g in line_rules.judged(table_of(spark, rows)).collect()}
    assert got[50] == (False, 72, False) and all(got[i] == (False, 72, False) for i in range(20))


# --- mixing ---------------------------------------------------------------------------------------

def expected_targets(size_of):
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size_of.values()), set()
    while True:
        rest = total - sum(3 * size_of[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size_of[s] if s in full else rest * weight[s] / open_weight for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * size_of[s]}
        if not above:
            return target
        full |= above


def mix_rows():
    r = random.Random(9)
    rows = [(i, prose(int(r.lognormvariate(3, 1)) + 1, r), r.choice(["a", "b", "c", "d", "é", None, "a"])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "only empty"), (None, "some words", "b"), (7000, "some words", "b"), (7000, "some words", "b"), (6000, "tiny", "Z")]
    return rows


def test_mixing(spark):
    rows = mix_rows()
    docs = table_of(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mixed(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    size_of = defaultdict(int)
    for _, t, s in rows:
        size_of[s] += len(words_of(t))
    target = expected_targets(size_of)
    taken, largest = defaultdict(int), defaultdict(int)
    for g in got:
        assert g["taken"] <= 3 * g["size"] and (g["size"] == 0 or g["taken"] % g["size"] == 0)
        assert g["source_size"] == size_of[g["source"]] and g["target"] == pytest.approx(target[g["source"]])
    full = mixing.mixed(docs)
    first = full.orderBy("doc_id", "taken").collect()
    assert first == mixing.mixed(docs.repartition(7)).orderBy("doc_id", "taken").collect() and len(first) == len(rows)
    for s in size_of:
        mine = [i for i, _, x in rows if x == s and i is not None]
        for g in first:
            if g["doc_id"] in mine and g["source_size"] == size_of[s]:
                taken[s] += g["taken"]
                largest[s] = max(largest[s], g["size"])
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 6
    assert mixing.mixed(docs.limit(0)).count() == 0
    copies = mixing.mix(table_of(spark, rows))
    assert sum(len(words_of(r["text"])) for r in copies.collect()) == sum(g["taken"] for g in first)


def test_multipliers_solve_the_dual(spark):
    docs = table_of(spark, mix_rows()).select("doc_id", "source", mixing.n_words().alias("size"))
    plan = mixing.mix_plan(docs).filter("lam is not null")
    for p in plan.collect():
        sizes = [r["size"] for r in docs.filter(F.col("source").eqNullSafe(F.lit(p["source"]))).collect()]
        reached = sum(s * min(3, math.exp(min(2, p["lam"] * s / p["scale"]))) for s in sizes)
        assert reached == pytest.approx(p["target"], rel=1e-5)


# --- rollups -------------------------------------------------------------------------------------

def test_rollups_are_additive_and_idempotent(spark, tmp_path):
    store = str(tmp_path / "store")
    schema = "before struct<source:string,lang:string,version:string,tokens:bigint>, after struct<source:string,lang:string,version:string,tokens:bigint>, docs string"
    a, b, c = ("s", "en", "1", 10), ("s", "en", "2", 12), (None, None, "1", None)
    batches = [[(None, a, "x"), (None, a, "x"), (None, c, "x")], [(a, b, "x"), (None, None, "x")], [], [(b, None, "x"), (c, None, "x")]]
    def now():
        return Counter(map(tuple, rollups.totals(spark, store).collect()))
    expected = [{("s", "en", "1", 2, 20): 1, (None, None, "1", 1, 0): 1},
                {("s", "en", "1", 1, 10): 1, ("s", "en", "2", 1, 12): 1, (None, None, "1", 1, 0): 1}, None, {("s", "en", "1", 1, 10): 1}]
    for i, rows in enumerate(batches):
        rollups.commit(spark.createDataFrame(rows, schema), store, i)
        rollups.commit(spark.createDataFrame(rows, schema), store, i)
        if expected[i]:
            assert now() == Counter(expected[i])
    rollups.commit(spark.createDataFrame(batches[1], schema), store, 1)
    assert now() == Counter(expected[3])
    assert rollups.totals(spark, str(tmp_path / "nothing")).count() == 0


def test_digest_columns(spark):
    docs = table_of(spark, [(1, "a b c")])
    kept = substrings.without_repeats(docs).select(F.sha2("kept", 256).alias("k")).first()["k"]
    assert kept == hashlib.sha256(b"a b c").hexdigest()
