"""Conversation trie, filter audit and SpotSigs against brute force, and their edge cases."""
import hashlib
import random
import zlib
from collections import Counter
from contextlib import contextmanager
from itertools import permutations

import pytest
import regex
from pyspark.sql import functions as F

from codecairn.llm import conversation_trie, filter_audit, spotsigs

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@contextmanager
def conf(spark, **settings):
    """Settings for a while; without coalescing, small tables lie in several partitions."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


# --- conversation trie -----------------------------------------------------------------------

def expected_trie(rows):
    """Rows of (conv_id, turn, role, text) to the counted node rows."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda t: (t[0], t[1], t[2], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest())
    turns = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = Counter()
    for node, ms in members.items():
        inside = [n for n in members if n[:len(node)] == node]
        kids = {n for n in members if len(n) == len(node) + 1 and n[:len(node)] == node}
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)
        ends = ",".join(map(str, sorted(c for c in ms if len(built[c]) == len(node))))
        out[(min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(kids), sum(map(leaf, inside)),
             sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in inside if n), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversation_rows():
    r = random.Random(5)
    rows = []
    for c in range(0, 40):
        first = [("user", "hello é"), ("bot", r.choice("xy"))] if c % 3 else []
        turns = first + [(r.choice(["user", "bot", None]), r.choice(["a", "b", "", None, "longer text"])) for _ in range(r.randrange(0, 9))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(71, k, "user", f"t{k}") for k in range(60)]  # a chain
    rows += [(c, k, "user", f"same {k}") for c in range(100, 130) for k in range(12)]  # copies, their bases among them
    rows += [(200, None, "user", "no turn"), (200, 1, "user", "x"), (200, 1, "user", "x"), (200, 1, "bot", "x"), (200, None, None, None)]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "n"), (-7, 1, "bot", "m"), (-5, 0, "user", "base"), (-5, 1, "bot", "m"),
             (303, 0, "user", "w" * 50_000), (2, 3, "user", "again"), (2, 3, "user", "again")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_trie_equals_brute_force(spark, coalesce):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns(
        {c: F.lit("clash") for c in ("node", "member", "depth", "part", "n", "h", "k", "size", "component")}).repartition(3)
    with conf(spark, spark__sql__adaptive__coalescePartitions__enabled=coalesce, spark__sql__shuffle__partitions="7"):
        got = conversation_trie.prefix_trie(table).collect()
    assert Counter(tuple(g) for g in got) == expected_trie(rows)


def test_running_over_partition_borders(spark):
    """One key in all partitions, one in two, and many in one."""
    r = random.Random(3)
    rows = [(k, i, r.getrandbits(60)) for k, n in ((1, 3), (2, 400), (3, 1), (4, 90), (5, 2)) for i in range(n)]
    with conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="9"):
        got = conversation_trie.running(spark.createDataFrame(rows, "k bigint, i bigint, t bigint").repartition(4), "k", [F.col("i")], ("t",))
        assert got.select("k", "i", "t").count() == len(rows)
        seen = {(g["k"], g["i"]): (g["n"], g["run_t"]) for g in got.collect()}
    sums, expected = {}, {}
    for k, i, t in rows:
        n, x = sums.get(k, (0, 0))
        sums[k] = expected[k, i] = (n + 1, x ^ t)
    assert seen == expected


def test_trie_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_trie.prefix_trie(empty).count() == 0
    nameless = spark.createDataFrame([(None, 1, "user", "x")], empty.schema)
    assert conversation_trie.prefix_trie(nameless).count() == 0


def test_rollup_of_any_shape(spark):
    """A chain, a star and a random tree: weights over subtrees, in at most log2(n) + 1 rounds."""
    r = random.Random(8)
    for kind in ("chain", "star", "random"):
        rows = []
        for c in range(1 if kind == "chain" else 25):
            length = 70 if kind == "chain" else 1 if kind == "star" else r.randrange(0, 8)
            rows += [(5 * c, k, "user", f"{k}" if kind == "chain" else f"{c}" if kind == "star" else r.choice("ab")) for k in range(length)]
        table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        assert Counter(tuple(g) for g in conversation_trie.prefix_trie(table).collect()) == expected_trie(rows)


# --- filter audit ----------------------------------------------------------------------------

def expected_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = t.encode().split()
        fails = {k for k, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= x <= "Z" for x in t) > 2 * len(t),
            any(x in "#$%&*|" for x in t), i is not None and i > first[t])) if f}
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], Counter()
        lines = []
        for order in permutations("ABCDE"):
            done = set()
            for step, x in enumerate(order, 1):
                gone = [d for d in mine if x in d[1] and not d[1] & done]
                lines.append(("".join(order), step, sum(not d[1] & (done | {x}) for d in mine), len(gone),
                              sum(x in d[1] and bool(d[1] & done) for d in mine), sum(d[1] == {x} for d in mine),
                              sum(d[2] for d in gone), sum(d[3] for d in gone)))
                shapley[x] += len(gone)
                done.add(x)
        for line in lines:
            out[(part, *line, shapley[line[0][line[1] - 1]])] = 1
    return out


def test_audit_equals_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(120):
        n = r.choice([3, 199, 200, 260])
        text = " ".join(r.choice(words[:r.choice([60, 500])]) for _ in range(n))
        text += r.choice(["", "", " " + "QX" * r.randrange(1, 20), " a|b", "\n\t", " é" * 5])
        rows.append((i, text, r.choice(["s1", "s2", None, ""])))
    rows += [(200 + i, rows[0][1], "s1") for i in range(30)] + [(200, rows[0][1], "s1"), (None, rows[0][1], "s2"), (None, "alone", "s2")]
    rows += [(300, None, "s1"), (301, "", "s1"), (302, None, "s2"), (303, "x " * 40_000, "s1"), (-4, rows[5][1], "s3")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 230, 3)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (9, None, None), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS).withColumns(
        {c: F.lit("clash") for c in ("part", "mask", "digest", "good", "step", "prefix")}).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit(1))
    got = filter_audit.audit(filter_audit.mask_cells(docs, marks)).collect()
    assert Counter(tuple(g) for g in got) == Counter(expected_audit(rows, labels))


def test_audit_without_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.mask_cells(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, "x", None, None, None)], DOCS)
    got = filter_audit.audit(filter_audit.mask_cells(one, labels))
    assert got.count() == 600 and {g["part"] for g in got.collect()} == {""}


# --- SpotSigs --------------------------------------------------------------------------------

def spots(text, chain=spotsigs.CHAIN, distance=spotsigs.DISTANCE):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            content = [x for x in words[i + 1:] if x not in anchors][:(chain - 1) * distance + 1:distance]
            if len(content) == chain:
                out.add((w, *content))
    return out or ({tuple(words)} if words else set())


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def spot_rows():
    r = random.Random(6)
    content = [f"wort{i}" for i in range(60)]

    def prose(n):
        return " ".join(r.choice(spotsigs.ANCHORS) if r.random() < 0.3 else r.choice(content) for _ in range(n)).capitalize() + "."
    texts = [prose(r.randrange(1, 120)) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), None, "", " \n", "wort1", "the", "the of and", "Éa the naïve wort—x 日本 the", "a" * 30_000,
              "the wort1 " * 3000, "of a b c d"]
    return [(2 * i, t) for i, t in enumerate(texts)] + [(None, "the wort1 wort2 wort3"), (None, None), (6, texts[0]), (10, texts[5]), (10, texts[5])]


def test_spotsigs_equal_brute_force(spark):
    rows = spot_rows()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumns(
        {c: F.lit("clash") for c in ("key", "at", "part", "rank", "signatures", "edited", "beginning")}).repartition(5)
    with conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = spotsigs.fingerprints(docs).collect()
    distinct = {(i, t or "") for i, t in rows}
    key = lambda d: hashlib.sha256(f"{'' if d[0] is None else d[0]}:{d[1]}".encode()).digest()
    order = sorted(distinct, key=lambda d: (d[0] is None, -(d[0] or 0), key(d)))
    following = {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    expected, likes = Counter(), {}
    for i, t in rows:
        t = t or ""
        half = len(t) // 2
        after = following[i, t][1]
        edited = t[:len(t) - half] + after[:half]
        row = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(spots(t)))
        expected[row] += 1
        likes[row] = (jaccard(spots(t), spots(edited)), jaccard(spots(t), spots(after)))
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"], g["n_signatures"]) for g in got) == expected
    for g in got:
        near = likes[g["doc_id"], g["n_chars"], g["edited_sha256"], g["n_signatures"]]
        assert (g["near_edited"], g["near_next"]) == pytest.approx(near)
    # equal sets, and only these, have equal fingerprints
    prints = {}
    for i, t in rows:
        prints.setdefault(frozenset(spots(t or "")), set())
    by_text = {(g["doc_id"], g["n_chars"]): g["fingerprint"] for g in got}
    for i, t in rows:
        if (i, len(t or "")) in by_text and i not in (6, 10, None):
            prints[frozenset(spots(t or ""))].add(by_text[i, len(t or "")])
    used = [p for p in prints.values() if p]
    assert all(len(p) == 1 for p in used) and len(set().union(*used)) == len(used)


def test_spotsigs_of_one_and_no_document(spark):
    one = spark.createDataFrame([(1, "the wort1 wort2 wort3 of wort4 wort5 wort6", None, None, None)], DOCS)
    (g,) = spotsigs.fingerprints(one).collect()
    assert g["near_next"] == 1.0 and g["n_signatures"] == 2
    assert spotsigs.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_spot_distance_and_pruned_likeness(spark):
    text = "The w1 w2 of w3 w4 w5 w6 a w7 w8 w9"
    got = spark.createDataFrame([(text,)], "t string").select(
        F.size(spotsigs.signatures(F.col("t"), chain=2, distance=2)).alias("n"), F.size(spotsigs.signatures(F.col("t"), chain=4)).alias("m")).first()
    assert tuple(got) == (len(spots(text, 2, 2)), len(spots(text, 4, 1)))
    sets = spark.createDataFrame([(list(range(a)), list(range(b))) for a in range(0, 40, 3) for b in range(0, 40, 3)], "a array<bigint>, b array<bigint>")
    for g in sets.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b")).alias("exact"), spotsigs.likeness(F.col("a"), F.col("b"), 0.75).alias("pruned")).collect():
        assert g["exact"] == pytest.approx(jaccard(set(g["a"]), set(g["b"])))
        assert g["pruned"] == g["exact"] or (g["pruned"] == 0 and g["exact"] < 0.75)
