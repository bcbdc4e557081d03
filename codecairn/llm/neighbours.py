"""Embedding near-duplicates by sorted projection passes.

In each pass vectors are ordered lexicographically by their signs along random directions, and every vector is compared
with the next ``WINDOW`` ones; where the far half of a window still holds a match, the window goes on, so that dense groups are
compared to their end. Cosines are computed in double precision; pairs at or above the limit are united
across passes. Vectors with equal components are one class first, so copies cost nothing and count fully.

A pass sorts by range over all partitions. A row whose window, or whose run of matches, reaches the end of its partition goes on
in the next one from where it was, and so on until its run ends, so a border changes no result.

A lone pair at the limit is found with probability ``RECALL`` among evenly spread vectors: the number of passes follows from the
number of vectors (``passes_for``). Pairs are listed, so the output of a dense group grows with the square of its distinct vectors.

Rows: one per input row. Vectors that are null, zero, of another length than the directions, or hold null or non-finite
components link with nothing. Repeated rows are separate vectors (copies of each other). vec_id may be null or repeated:
component_id is the smallest known vec_id of the component (null if there is none), and a row that has no vec_id is kept.
Labels and other columns are not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codecairn.llm.components import components
from codecairn.llm.tables import fields, map_rows, table, typed
from codecairn.sources.scratch import saved

LEAST = 0.95
PASSES, BITS, WINDOW = 12, 64, 48
#: Share of lone pairs at the limit that the passes find together; ``PASSES`` is the least number of passes.
RECALL = 0.99
#: Rows of one sorted partition (16 MB at 64 components).
ROWS_PER_PARTITION = 50_000
#: Pairs that a task holds before it hands them on.
PAIRS_HELD = 1_000_000
SEED = 20240611


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, vec_id, digest) per row, null digest for unusable vectors; (node, copies, vec) per class of equal vectors."""
    schema = T.StructType([*fields(vectors, "vec_id"), *typed("row_id bigint, digest binary, vec binary")])

    def task(rows):
        row = TaskContext.get().partitionId() << 40
        for b in rows:
            out = [(None, None)] * b.num_rows
            for i, v in enumerate(b.column(1).to_pylist()):
                if v is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64) + 0.0  # the sum makes -0.0 and 0.0 equal
                if len(x) and np.isfinite(x).all() and x.any():
                    out[i] = hashlib.md5(x.tobytes()).digest(), x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(row, row + len(out)), pa.int64()),
                                              *(pa.array(c, pa.binary()) for c in (list(zip(*out)) or [[], []]))], schema.names)
            row += len(out)

    rows = saved(map_rows(vectors, ["vec_id", "embedding"], schema, task), "vectors")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("row_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    return rows.select("row_id", "vec_id", "digest"), saved(nodes, "classes")


def matrix(blobs: list[bytes]) -> np.ndarray:
    """Rows of length 1 in double precision. All blobs have one length."""
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, passes * BITS))


def passes_for(n: int, least: float = LEAST, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the limit was in one window with this probability: the vectors of a window share about
    log2(n / window) leading signs, and a pair shares a sign with probability 1 - angle / pi."""
    together = (1 - math.acos(least) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if together >= 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def pairs_in_order(x: np.ndarray, window: int, least: float, open_rows: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows in sorted order with a cosine of at least ``least``, some at a time. ``open_rows`` gets the rows
    whose comparisons are not over at the last row, each with the offset of its last match."""
    found, held = [], 0
    active = np.arange(len(x))
    hit = np.zeros(len(x), np.int64)
    k = 1
    while len(active):
        if k > window:  # go on only where the last half window had a match
            active = active[hit[active] > k - 1 - window // 2]
        over = active + k >= len(x)
        open_rows += zip(active[over].tolist(), hit[active[over]].tolist())
        active = active[~over]
        j = active + k
        near = np.einsum("ij,ij->i", x[active], x[j]) >= least
        hit[active[near]] = k
        found.append((active[near], j[near]))
        held += len(found[-1][0])
        if held >= PAIRS_HELD or not len(active):
            yield tuple(np.concatenate(c) for c in zip(*found))
            found, held = [], 0
        k += 1


class Carried:
    """Rows that go on in one partition: they meet its rows in order, all at the same place."""

    def __init__(self, window: int, least: float):
        self.window, self.least = window, least
        self.rows: list[tuple[int, int, int, bytes]] = []  # node, rows compared so far, offset of the last match, vector
        self.x = None
        self.met = 0

    def begin(self) -> None:
        node, seen, hit, self.blobs = zip(*self.rows)
        self.node, self.seen, self.hit = (np.array(c, np.int64) for c in (node, seen, hit))
        self.active = np.arange(len(node))
        self.x = matrix(self.blobs)

    def meet(self, blob: bytes) -> np.ndarray:
        """The nodes that match the partition's next row."""
        if self.x is None:
            self.begin()
        k = self.seen[self.active] + self.met + 1
        on = (k <= self.window) | (self.hit[self.active] > k - 1 - self.window // 2)
        if len(blob) != len(self.blobs[0]):
            on[:] = False
        if not on.all():
            self.active, self.x, k = self.active[on], self.x[on], k[on]
        self.met += 1
        if not len(self.active):
            return self.active
        near = self.x @ matrix([blob])[0] >= self.least
        self.hit[self.active[near]] = k[near]
        return self.node[self.active[near]]

    def rest(self) -> list[tuple[int, int, int, bytes]]:
        """The rows that still go on."""
        return self.rows if self.x is None else [(int(self.node[i]), int(self.seen[i]) + self.met, int(self.hit[i]), self.blobs[i]) for i in self.active]


def linked(nodes: DataFrame, least: float = LEAST, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes that some pass found."""
    n = nodes.count()
    passes = passes or passes_for(n, least, window)
    coded = T.StructType(typed("pass int, code binary, node bigint, vec binary"))

    def code(rows):
        for b in rows:
            node, blobs = b.column(0).to_pylist(), b.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(blobs):
                by_dim.setdefault(len(v), []).append(i)
            for size, at in by_dim.items():
                x = matrix([blobs[i] for i in at])
                signs = (x @ directions(size // 8, passes) >= 0).reshape(len(at), passes, BITS)
                bits = np.packbits(signs, axis=2)
                for p in range(passes):
                    prefix = size.to_bytes(4, "big")  # vectors of one length are neighbours
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * len(at), pa.int32()), pa.array([prefix + r.tobytes() for r in bits[:, p]], pa.binary()),
                         pa.array([node[i] for i in at], pa.int64()), pa.array([blobs[i] for i in at], pa.binary())], coded.names)

    parts = max(1, -(-n * passes // ROWS_PER_PARTITION))
    ordered = map_rows(nodes, ["node", "vec"], coded, code).repartitionByRange(parts, "pass", "code", "node").sortWithinPartitions(
        "pass", "code", "node")
    # a pair (a, b), or a row to be compared in partition ``part``: its own (``at`` is its place), or one that goes on there
    # (``at`` is -1), of which ``seen`` rows behind it were compared, the last match at the offset ``hit``
    found = T.StructType(typed("a bigint, b bigint, part int, at int, seen bigint, hit bigint, node bigint, vec binary"))
    arrow = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batches(columns: list, first: int):
        """Batches of these columns, the others null."""
        for s in range(0, len(columns[0]), 10_000):
            c = [pa.array(v[s:s + 10_000], t) for v, t in zip(columns, arrow[first:])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(c[0]), t) for t in arrow[:first]] + c + [
                pa.nulls(len(c[0]), t) for t in arrow[first + len(c):]], found.names)

    def pairs(a: np.ndarray, b: np.ndarray):
        both = np.unique(np.sort(np.stack([a, b], axis=1), axis=1), axis=0)
        return batches([both[:, 0], both[:, 1]], 0)

    def going(part: int, rows: list[tuple[int, int, int, bytes]]):
        if rows:
            node, seen, hit, blobs = zip(*rows)
            yield from batches([[part] * len(rows), [-1] * len(rows), seen, hit, node, blobs], 2)

    def compare(rows):
        """Pairs inside the partition; its rows, the first window of them with their vectors; the rows that go on behind it."""
        part = TaskContext.get().partitionId()
        held = list(rows)  # one partition, bounded by ROWS_PER_PARTITION
        node = [v for b in held for v in b.column(0).to_pylist()]
        blobs = [v for b in held for v in b.column(1).to_pylist()]
        if not node:
            return
        ids, start, open_rows = np.array(node, np.int64), 0, []
        while start < len(ids):
            end = start
            while end < len(ids) and len(blobs[end]) == len(blobs[start]):
                end += 1
            open_rows = []
            for i, j in pairs_in_order(matrix(blobs[start:end]), window, least, open_rows):
                yield from pairs(ids[start + i], ids[start + j])
            first, start = start, end
        none = [None] * len(node)
        yield from batches([[part] * len(node), list(range(len(node))), none, none, node, blobs[:window] + none[window:]], 2)
        yield from going(part + 1, [(node[first + i], len(node) - 1 - first - i, hit, blobs[first + i]) for i, hit in open_rows])

    def across(step: int):
        """Compares rows that go on with the partition's own, sorted by part and place; what still goes on, does so ``step`` parts on."""
        def task(rows):
            part, carried, a, b = None, None, [], []
            for batch in rows:
                for r in batch.to_pylist():
                    if r["part"] != part:
                        if carried:
                            yield from going(part + step, carried.rest())
                        part, carried = r["part"], Carried(window, least)
                    if r["at"] < 0:
                        carried.rows.append((r["node"], r["seen"], r["hit"], r["vec"]))
                    elif carried.rows:
                        near = carried.meet(r["vec"])
                        a.append(near)
                        b.append(np.full(len(near), r["node"]))
                if sum(map(len, a)):
                    yield from pairs(np.concatenate(a), np.concatenate(b))
                a, b = [], []
            if carried:
                yield from going(part + step, carried.rest())
        return task

    names = found.names[2:]
    out = saved(map_rows(ordered, ["node", "vec"], found, compare), "window-pairs")
    all_pairs, own = [out.filter("a is not null").select("a", "b")], out.filter("at >= 0").select(names)
    carried = out.filter(f"at < 0 and part < {parts}").select(names)
    turn = 0
    while carried.limit(1).count():
        # first the next partition's first rows, which end nearly all windows; then its others; then whole partitions
        if turn == 0:
            beside = own.filter("vec is not null")
        else:
            beside = own.filter("vec is null" if turn == 1 else "true").join(carried.select("part").distinct(), "part", "left_semi").drop("vec").join(
                nodes.select("node", "vec"), "node").select(names)
        both = carried.unionAll(beside).repartition("part").sortWithinPartitions("part", "at")
        more = saved(map_rows(both, names, found, across(0 if turn == 0 else 1)), "border-pairs")
        all_pairs.append(more.filter("a is not null").select("a", "b"))
        carried = more.filter(f"at < 0 and part < {parts}").select(names)
        turn += 1
    return reduce(DataFrame.unionAll, all_pairs).filter("a <> b").distinct()


def near_duplicates(vectors: DataFrame, least: float = LEAST, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows, nodes = classes(vectors)
    edges = saved(linked(nodes, least, passes, window), "links")
    weighed = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(
        nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    roots = components(edges)
    per_class = (nodes.select("digest", "node", "copies").join(weighed, F.col("node") == F.col("a"), "left")
                 .join(roots, "node", "left")
                 .select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("root", "node").alias("root")))
    labelled = saved(rows.join(per_class, "digest", "left").withColumn(
        "root", F.coalesce("root", -1 - F.col("row_id"))), "labelled")  # an unusable vector is its own component
    least_id = labelled.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return labelled.join(least_id, "root").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
