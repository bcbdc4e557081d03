"""Jaccard near-duplicates of documents by shingles: an exact metric-space join over pivots.

Distance is 1 - |x & y| / |x | y| over sets of 5-word shingles; documents link at a distance of at most 1/4.
Unrelated documents are all at distance 1, so distances alone would put everything into every window. Regions therefore come
from shingles: taken in a fixed order, two linked documents share k of their first |x| - ceil(3/4 |x|) + k. Prefixes are longer by an eighth of
the size than they must be for k = 1, and a document that shares fewer with all others together than it would with one is left out. The pivot of a shingle is the
document of least hash among those that have it there; a document is in the regions of the pivots of all these shingles, and at home in
that of the pivot it shares most of them with. Two linked documents share a shingle and with it a region, so regions are joined one by one.
Shingles that very many documents have come last in the order.

A document's distance to its home pivot is measured first, then those to its other pivots as far as they are not connected yet.
What is linked with its pivot is connected, so pairs of a region matter only where a document is left outside of its largest component: by
the triangle inequality it can only be near those whose distance to the pivot differs by at most 1/4 from its own. A region is joined in
one task, a larger one by pairs of blocks; a member travels once for each block of its region. Where a block has more pairs left than members,
those of the nearest members come first; only regions with such a block are joined again.

Distances are bounded before they are measured: shingles fall into hash classes, and where a class has an odd number of shingles in one
document and an even one in the other, their sets differ. Only pairs that these bounds leave open are compared on their whole texts; these
are found by a hash of the text, so other texts are neither cut into shingles again nor shuffled.

Rows: one per input row. A null text or one without words has an empty set: n_shingles 0, a component of its own. With fewer
than five words the sequence is one shingle. Texts with equal sets are one node, whatever their doc_id. A component's id is
its smallest known doc_id (null if none is). Other columns are not read. Sets and nodes are told apart by 64-bit hashes.
"""
from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codecairn.llm.components import components
from codecairn.llm.shared_keys import shared_keys, signed
from codecairn.llm.tables import fields, map_rows, table, typed
from codecairn.llm.words import blocks, distinct, windows, word_hashes
from codecairn.sources.scratch import discard, saved

SHINGLE = 5
#: A shingle of more documents is hot; of such ones, the most frequent (a bound for what is sent to tasks) come last in the order.
CELL, LATE_KEYS = 64, 200_000
#: Members of a region that meet in one task, about.
BLOCK = 500
#: Up to so many wanted texts, their hashes are sent to the tasks that read the documents; of more, the texts are packed and shuffled.
SENT = 1_000_000
#: Pairs, or bytes of sketches, that a task looks at in one step.
STEP = 1 << 17


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    out = []
    for a, b in blocks(texts):
        words, at = word_hashes([t.lower() for t in texts[a:b]])
        for i in range(b - a):
            mine = words[at[i]:at[i + 1]]
            out.append(distinct(windows(mine, min(SHINGLE, len(mine)))) if len(mine) else mine)
    return out


def node_of(shingles: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def spare(n: int) -> int:
    """By how many shingles a prefix is longer than it has to be for one shared shingle; grows with the size."""
    return n // 8


def least_shared(n: Column) -> Column:
    """So many shingles of its prefix a document of ``n`` shares with that of any that it is linked with, whose size is ceil(3/4 n) at least."""
    return 1 + F.floor(F.ceil(n * 3 / 4) / 8)


def prefix(shingles: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The shingles whose cells the document is in: those outside ``late`` (sorted) first, then by hash."""
    n = len(shingles)
    if len(late):
        is_late = late[np.minimum(np.searchsorted(late, shingles), len(late) - 1)] == shingles
        shingles = np.concatenate([shingles[~is_late], shingles[is_late]])
    return shingles[:n - (3 * n + 3) // 4 + 1 + spare(n)]


def sketch(shingles: np.ndarray) -> bytes:
    """A bit per hash class, about four classes a shingle: whether the class has an odd number of shingles."""
    classes = 1 << min(19, max(6, int(len(shingles) - 1).bit_length() + 2))
    counts = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def rows_of(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of bytes."""
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches in fewer classes: an odd number of odd ones is odd."""
    return sketches if sketches.shape[1] == size else np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, size), axis=1)


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference: where a class is odd in one and even in the other, the sets differ there."""
    return int(least_differences(rows_of([a]), rows_of([b]))[0])


def least_differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for rows of sketches, or one row against many; the finer ones are folded."""
    n = min(x.shape[1], y.shape[1])
    return np.bitwise_count(folded(x, n) ^ folded(y, n)).sum(axis=1, dtype=np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, code (a hash of the text), node (null for an empty set), n_shingles, sketch."""
    schema = T.StructType([*fields(docs, "doc_id"), *typed("code bigint, node bigint, n_shingles bigint, sketch binary")])

    def task(rows):
        for b in rows:
            sets = shingle_sets([(t or "").encode() for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], schema.names)

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("code"), "text"), ["doc_id", "code", "text"], schema, task)


def cells(docs: DataFrame, late: np.ndarray, parts: int) -> DataFrame:
    """(node, key) for the cells that two nodes or more are in; (null, key, n) for the hot ones."""
    sent = docs.sparkSession.sparkContext.broadcast(late)

    def make():
        seen: set[int] = set()

        def keys_of(batch):
            nodes, cut = [], []
            for shingles in shingle_sets([(t or "").encode() for t in batch.column(0).to_pylist()]):
                if len(shingles) and (node := node_of(shingles)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    cut.append(prefix(shingles, sent.value))
            keys = np.concatenate(cut) if cut else np.empty(0, np.uint64)
            return np.array(nodes, np.int64), keys, np.repeat(np.arange(len(cut)), [len(c) for c in cut])

        return keys_of

    return shared_keys(docs, ["text"], make, parts, CELL)


_PAIR = "a bigint, b bigint, low double, high double, linked boolean"


def measured(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes with bounds ``low`` and ``high`` of their distance and whether they are ``linked``.

    The bounds are one where the whole texts were compared: that is where sizes and sketches leave a link possible.
    """
    a, b = (nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    result = T.StructType(typed(_PAIR + ", open boolean"))

    def by_sketch(rows):
        for r in rows:
            m, n = (r.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            differ = np.maximum(np.array([least_difference(x, y) for x, y in zip(r.column(4).to_pylist(), r.column(5).to_pylist())], np.int64), np.abs(m - n))
            low, count = 2 * differ / np.maximum(m + n + differ, 1), r.num_rows
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(low), pa.array(np.ones(count)), pa.array(np.zeros(count, bool)),
                                              pa.array(7 * differ <= m + n)], result.names)

    bounds = saved(map_rows(pairs.join(a, "a").join(b, "b"), ["a", "b", "n_a", "n_b", "s_a", "s_b"], result, by_sketch), "bounds")
    return bounds.filter("not open").drop("open").unionAll(compared(bounds.filter("open").select("a", "b"), docs, nodes))


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with their distances from the whole texts."""
    result = T.StructType(typed(_PAIR))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "code"), "node")
    texts = texts_of(docs, saved(wanted, "wanted"))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("t_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("packed").alias("t_b")), "b")

    def by_text(rows):
        z = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=512)
        def of(packed):
            return shingle_sets([z.decompress(packed)])[0]

        for r in rows:
            away, linked = [], []
            for x, y in zip(r.column(2).to_pylist(), r.column(3).to_pylist()):
                x, y = of(x), of(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                away.append(1 - common / union)
                linked.append(100 * common >= 75 * union)
            away = pa.array(away, pa.float64())
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), away, away, pa.array(linked, pa.bool_())], result.names)

    distances = saved(map_rows(both, ["a", "b", "t_a", "t_b"], result, by_text), "distances")
    discard(texts)
    return distances


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed): one compressed text per wanted node (node, code)."""
    schema = T.StructType(typed("node bigint, packed binary"))

    def task(rows):
        z, seen = zstandard.ZstdCompressor(level=3), set()
        for b in rows:
            texts, nodes = [t.encode() for t in b.column(0).to_pylist()], []
            for s, t in zip(shingle_sets(texts), texts):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    nodes.append((node, z.compress(t)))
            yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in nodes], pa.int64()), pa.array([n[1] for n in nodes], pa.binary())],
                                             schema.names)

    rows = docs.filter("text is not null").select("text")
    if wanted.count() <= SENT:
        rows = rows.withColumn("code", F.xxhash64("text")).join(F.broadcast(wanted.select("code").distinct()), "code", "left_semi")
    packed = map_rows(rows, ["text"], schema, task).join(wanted.select("node"), "node", "left_semi")
    return saved(packed.groupBy("node").agg(F.first("packed").alias("packed")), "texts")


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links (a, b); only roots that these connect are looked at."""
    def root_of(c: str) -> DataFrame:
        return roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))

    edges = found.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
    new = components(edges).withColumnRenamed("root", "to")
    known = roots.join(new.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    others = new.join(roots.select("node"), "node", "left_anti").select("node", F.col("to").alias("root"))
    return saved(known.unionAll(others), "roots")


def in_open_regions(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(pivot, node, low, high, root): the members of the regions that hold two components or more."""
    labelled = members.join(roots, "node", "left").select("pivot", "node", "low", "high", F.coalesce("root", "node").alias("root"))
    several = labelled.groupBy("pivot").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("pivot")
    return saved(labelled.join(several, "pivot", "left_semi"), "open-regions")


def possible_pairs(n: np.ndarray, root: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, outside: np.ndarray,
                   sketches: list[bytes], across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (x, y) of members that may be linked, x outside the largest component, and the least differences of their sets."""
    sizes = np.array([len(s) for s in sketches])
    tables = {size: (np.cumsum(sizes == size) - 1, rows_of([s for s in sketches if len(s) == size]).view(np.uint64)) for size in set(sizes.tolist())}
    at, out = np.flatnonzero(outside), []
    step = max(1, STEP // len(n))
    for start in range(0, len(at), step):
        mine = at[start:start + step, None]
        may = (root != root[mine]) & (4 * np.minimum(n, n[mine]) >= 3 * np.maximum(n, n[mine])) & (low <= high[mine] + 0.25 + 1e-9) & (low[mine] <= high + 0.25 + 1e-9)
        if across:
            may &= own != own[mine]
        x, y = np.nonzero(may)
        x = mine[x, 0]
        differ = np.zeros(len(x), np.int64)
        for (i, mine_of), (j, theirs_of) in ((a, b) for a in tables.items() for b in tables.items()):
            here = np.flatnonzero((sizes[x] == i) & (sizes[y] == j))
            few = max(1, STEP // max(i, j))
            for k in range(0, len(here), few):
                pairs = here[k:k + few]
                differ[pairs] = least_differences(mine_of[1][mine_of[0][x[pairs]]], theirs_of[1][theirs_of[0][y[pairs]]])
        possible = 7 * differ <= n[x] + n[y]
        out.append((x[possible], y[possible], differ[possible]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def joined(left: DataFrame, nodes: DataFrame, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of members of open regions (pivot, node, low, high, root) that may be linked though their roots differ.

    One of the two is outside the largest component of the region. Sizes, windows and sketches are tested where a block of a region meets another.
    With ``nearest``, a block with more such pairs than members gives only the pair of least bound for each member outside and other component,
    and (pivot, null) to say so.
    """
    sizes = left.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("n"))
    regions = sizes.groupBy("pivot").agg(F.max(F.struct("n", "root")).alias("m"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    placed = left.join(regions.select("pivot", F.col("m.root").alias("largest"), "blocks"), "pivot").join(
        nodes.select("node", "n_shingles", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "low", "high", "root",
        (F.col("root") != F.col("largest")).alias("outside"), "n_shingles", "sketch")
    result = T.StructType(typed("a bigint, b bigint"))
    names = ("pivot", "i", "j", "node", "root", "own", "n_shingles", "low", "high", "outside")

    def meet(pivot, i, j, node, root, own, n, low, high, outside, sketches):
        x, y, differ = possible_pairs(n, root, own, low, high, outside, sketches, i[0] != j[0])
        once = ~outside[y] | (x < y)
        if not nearest or np.count_nonzero(once) <= len(node):
            return node[x[once]], node[y[once]], []
        order = np.lexsort((node[y], differ, root[y], x))
        x, y = x[order], y[order]
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (root[y[1:]] != root[y[:-1]])])
        return node[x[first]], node[y[first]], [int(pivot[0])]

    def task(batches):
        held = None
        for batch in chain(batches, [None]):
            parts = [b for b in (held, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            columns = [rows.column(c).to_numpy(zero_copy_only=False) for c in names]
            key = np.stack(columns[:3])
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [rows.num_rows]])
            last = len(starts) - 1 if batch is None else len(starts) - 2  # the last region may go on in the next batch
            sketches = rows.column("sketch").slice(0, starts[last]).to_pylist()
            found = [meet(*(c[s:e] for c in columns), sketches[s:e]) for s, e in zip(starts[:last], starts[1:last + 1])]
            a = np.concatenate([np.empty(0, np.int64), *(f[0] for f in found)])
            b = np.concatenate([np.empty(0, np.int64), *(f[1] for f in found)])
            more = [p for f in found for p in f[2]]
            yield pa.RecordBatch.from_arrays([pa.array(a.tolist() + more, pa.int64()), pa.array(b.tolist() + [None] * len(more), pa.int64())], result.names)
            held = rows.slice(starts[last])

    ordered = dealt.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return map_rows(ordered, ordered.columns, result, task)


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): equal roots for the nodes that links connect; nodes without a link may be missing."""
    spark = docs.sparkSession
    parts = max(8, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = cells(docs, np.empty(0, np.uint64), parts).filter("node is null").orderBy(F.desc("n"), "key").limit(LATE_KEYS)
    late = np.sort(np.array([r["key"] for r in hot.select("key").toLocalIterator()], np.int64).view(np.uint64))
    listed = saved(cells(docs, late, parts).filter("node is not null").select("node", "key"), "cells")
    enough = listed.groupBy("node").agg(F.count(F.lit(1)).alias("shared")).join(nodes.select("node", "n_shingles"), "node").filter(
        F.col("shared") >= least_shared(F.col("n_shingles")))
    rows = saved(listed.join(enough.select("node"), "node", "left_semi"), "cells")
    discard(listed)
    pivots = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    regions = saved(rows.join(pivots, "key").groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("n")), "regions")
    discard(rows)

    def new(pairs: DataFrame, seen: DataFrame | None) -> DataFrame:
        """Distinct pairs (a, b), a < b, that were not measured before."""
        ordered = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return ordered if seen is None else ordered.join(seen.select("a", "b"), ["a", "b"], "left_anti")

    home = regions.filter("pivot <> node").groupBy("node").agg(F.max(F.struct("n", "pivot")).alias("m")).select(
        F.col("node").alias("a"), F.col("m.pivot").alias("b"))
    seen = measured(new(home, None), docs, nodes)
    roots = saved(components(seen.filter("linked").select("a", "b")), "roots")
    unknown = regions.select("pivot", "node", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    apart = in_open_regions(unknown, roots)
    of_pivot = apart.filter("pivot = node").select("pivot", F.col("root").alias("pivot_root"))
    others = apart.join(of_pivot, "pivot").filter("root <> pivot_root").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    more = measured(new(others, seen), docs, nodes)
    seen, roots = seen.unionAll(more), merged(roots, more.filter("linked").select("a", "b"))
    away = seen.select("a", "b", "low", "high").unionAll(seen.select(F.col("b").alias("a"), F.col("a").alias("b"), "low", "high"))
    known = regions.select("pivot", "node").join(away.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "low", "high"), ["pivot", "node"], "left")
    at_home = F.col("pivot") == F.col("node")
    members = saved(known.select("pivot", "node", F.when(at_home, 0.0).otherwise(F.coalesce("low", F.lit(0.0))).alias("low"),
                                 F.when(at_home, 0.0).otherwise(F.coalesce("high", F.lit(1.0))).alias("high")), "members")
    # First the nearest pair of a member and a component: most components that belong together are one then, and their other pairs need no look.
    for nearest in (True, True, False):
        met = saved(joined(in_open_regions(members, roots), nodes, nearest), "met")
        found = compared(saved(new(met.filter("b is not null"), seen), "hopeful"), docs, nodes)
        seen, roots = seen.unionAll(found), merged(roots, found.filter("linked").select("a", "b"))
        unfinished = met.filter("b is null").select(F.col("a").alias("pivot")).distinct()
        if not unfinished.limit(1).count():
            break
        members = members.join(unfinished, "pivot", "left_semi")
    return roots


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (equal for texts with equal sets), root (equal within a component); both null for empty sets."""
    profile = saved(profiles(docs), "profiles")
    nodes = saved(profile.filter("node is not null").groupBy("node").agg(
        F.first("code").alias("code"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "nodes")
    roots = links(docs, nodes)
    return profile.select("doc_id", "node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    labelled = grouped(docs)
    least = labelled.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def with_node(docs: DataFrame) -> DataFrame:
    """(row, node): every row as one struct, so that no column of the caller can clash, and the node of its text."""
    schema = T.StructType([T.StructField("row", T.StructType(fields(docs, *docs.columns)), True), *typed("node bigint")])

    def task(rows):
        for b in rows:
            sets = shingle_sets([(t or "").encode() for t in b.column(0).field("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], schema.names)

    return map_rows(docs.select(F.struct(*docs.columns).alias("row")), ["row"], schema, task)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: that of the smallest doc_id (known ones
    first), and among its rows the least text. Documents with empty sets are in no group and all stay.

    The text is shuffled once; rows that share doc_id and set lie together after the join already.
    """
    labelled = grouped(docs).filter("node is not null")
    key = F.xxhash64("doc_id").alias("key")
    stay = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("m")).select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.node").alias("node")).select(key, "node", F.lit(True).alias("stays"))
    alone = F.when(F.col("node").isNull(), F.monotonically_increasing_id())  # a row without a set is matched with nothing
    keyed = with_node(docs).select("row", "node", F.coalesce(alone, F.lit(-1)).alias("alone"), F.xxhash64("row.doc_id").alias("key"))
    kept = keyed.withColumn("node", F.coalesce("node", "alone")).join(stay, ["key", "node"], "left").filter("stays or alone >= 0")
    one = kept.groupBy("key", "node", "alone").agg(F.min_by("row", "row.text").alias("least"), F.first("row").alias("any"))
    return one.select(F.coalesce("least", "any").alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
