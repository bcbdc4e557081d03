"""The prefix trie of conversations, with totals of every subtree by centroid decomposition.

A node is a distinct sequence of first turns; its id is a 120-bit digest of it (an exclusive or of digests of turns with their depth, so
that prefixes add up over partitions). A node is listed with the smallest conversation that has it, its owner.

Rollup: a component is a connected piece of the tree, at first all of it. Of each component the nodes above half of its size form a path
from its top to its centroid. The weights at and below the centroid are summed, added to every node of that path, and the centroid is
done. Each child of it becomes a component, the rest above another. All components of a round are split together, and no component
is larger than half of the one it came from, so the rounds are at most log2(nodes) + 1, for chains and stars alike.

Rows: turns without conv_id belong to no conversation. Turns of a conversation are ordered by turn (null first), then role
and a digest of (role, text); repeated rows are turns of their own. A null role or text is empty. Negative conv_ids are
divided towards zero. Other columns are not read. Without conversations there is no node.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codecairn.llm.tables import batches, fields, table, typed
from codecairn.sources.scratch import saved

#: Own turns are taken from a conversation whose number is divisible by ``FAMILY``; at most ``HEAD`` - 1 of them.
FAMILY, HEAD = 5, 9
#: Conversation numbers in one piece of the text whose digest lists a node's ends.
PIECE = 256
EMPTY = hashlib.sha256(b"").hexdigest()


# --- sums along sorted rows -------------------------------------------------------------------------------

def running(df: DataFrame, key: str, order: list[Column], terms: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``n``, their number within ``key`` (from 1) in the given order, and the running exclusive or of each term.

    Rows are sorted over all partitions, so a key of any size is in many of them; a task reads its own as a stream. What
    a key brings from earlier partitions is read from one row per partition that it enters, and added afterwards.
    """
    spark = df.sparkSession
    names = df.columns
    schema = T.StructType([*fields(df, *names), *typed("part int, n bigint" + "".join(f", run_{t} bigint" for t in terms))])

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, carried = None, 0, [np.int64(0)] * len(terms)
        for b in rows:
            size = b.num_rows
            if not size:
                continue
            keys = b.column(names.index(key)).to_numpy(zero_copy_only=False)
            start = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(size), -1))
            n = np.arange(size) - first + 1
            n[first < 0] = np.arange(size)[first < 0] + 1 + count
            runs = []
            for j, t in enumerate(terms):
                x = np.bitwise_xor.accumulate(b.column(names.index(t)).to_numpy(zero_copy_only=False))
                before = np.where(first > 0, x[np.maximum(first, 1) - 1], np.where(first < 0, carried[j], 0))
                runs.append(x ^ before)
            last, count, carried = keys[-1], n[-1], [r[-1] for r in runs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(size, part, np.int32)), pa.array(n.astype(np.int64)),
                                              *(pa.array(r.astype(np.int64)) for r in runs)], schema.names)

    ordered = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    local = saved(ordered.mapInArrow(lambda rows: task(batches(rows, 10_000)), schema), "running")
    edges = sorted(local.groupBy("part").agg(F.min(key), F.max(key)).collect())  # a row per partition
    entered = [(p, k) for (_, _, a), (p, k, _) in zip(edges, edges[1:]) if a == k]
    left = sorted({(p, a) for (p, _, a), (_, k, _) in zip(edges, edges[1:]) if a == k})
    brought = []
    if entered:
        there = spark.createDataFrame(left, f"part int, {key} bigint")
        sums = {(r["part"], r[key]): r[2:] for r in local.join(F.broadcast(there), ["part", key]).groupBy("part", key).agg(
            F.max("n"), *(F.bit_xor(t) for t in terms)).collect()}
        total: dict[int, list[int]] = {}
        for (p, _, a), (q, k, _) in zip(edges, edges[1:]):
            if a != k:
                continue
            s = sums[p, a]
            old = total.get(k, [0] * len(s))
            total[k] = [old[0] + s[0], *(x ^ y for x, y in zip(old[1:], s[1:]))]
            brought.append((q, k, *total[k]))
    carry = spark.createDataFrame(brought, f"part int, {key} bigint, n_0 bigint" + "".join(f", run_{t}_0 bigint" for t in terms))
    whole = local.join(F.broadcast(carry), ["part", key], "left")
    zero = F.lit(0).cast("bigint")
    return whole.select(*names, (F.col("n") + F.coalesce("n_0", zero)).alias("n"),
                        *(F.col(f"run_{t}").bitwiseXOR(F.coalesce(f"run_{t}_0", zero)).alias(f"run_{t}") for t in terms))


# --- conversations ----------------------------------------------------------------------------------------

def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, d1, d2, size): each turn's place from 1, 120 bits of its digest, the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("bigint")
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        part(1).alias("d1"), part(16).alias("d2"), F.octet_length(text).cast("bigint").alias("size"))
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("d1"), F.col("d2")])
    return placed.select("conv_id", F.col("n").alias("at"), "d1", "d2", "size")


def heads(turns: DataFrame) -> DataFrame:
    """(conv_id, base, h, k, length): turns k of the h wanted are there to be taken from the base; turns in all."""
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    c = F.col("conv_id")
    plan = sizes.select(c, "own", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string").cast("binary")) % HEAD).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    k = F.least("h", F.coalesce("there", F.lit(0).cast("bigint")))
    return plan.join(bases, "base", "left").select(
        "conv_id", "base", "h", k.alias("k"), (k + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def rebuilt(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """(member, depth, d1, d2, size, ends): the turns of every rebuilt conversation; ``ends``: it has no further one."""
    b = turns.filter(F.col("at") < HEAD).withColumnRenamed("conv_id", "base")
    taken = b.join(plan, "base").filter(F.col("at") <= F.col("h")).withColumn("depth", F.col("at"))
    own = turns.join(plan, "conv_id").filter(F.col("at") > F.col("h")).withColumn("depth", F.col("at") - F.col("h") + F.col("k"))
    return taken.unionByName(own, allowMissingColumns=True).select(
        F.col("conv_id").alias("member"), "depth", "d1", "d2", "size", (F.col("depth") == F.col("length")).alias("ends"))


def node_id(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def root() -> Column:
    """The id of the empty sequence."""
    return F.lit(bytes(16))


def prefixes(turns: DataFrame) -> DataFrame:
    """(member, depth, node, parent, size, ends): every member of every node below the root."""
    low = (1 << 60) - 1
    terms = turns.withColumn("t1", F.xxhash64("d1", "d2", "depth").bitwiseAND(low)).withColumn(
        "t2", F.xxhash64("depth", "d2", "d1", F.lit(1)).bitwiseAND(low)).drop("d1", "d2")
    summed = running(terms, "member", [F.col("depth")], ("t1", "t2"))
    before = [F.col(f"run_{t}").bitwiseXOR(F.col(t)) for t in ("t1", "t2")]
    return summed.select("member", "depth", node_id(F.col("run_t1"), F.col("run_t2")).alias("node"), node_id(*before).alias("parent"), "size", "ends")


# --- the trie ---------------------------------------------------------------------------------------------

def trie(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """A row per node: node, depth, conv_id (owner), parent, parent_conv_id, n_convs, n_children, weights, and its subtree's nodes.

    A conversation owns the end of its path, from some depth on. All that a member of a node owns is below the node, but
    for the owner, whose nodes above it do not count: so subtree sizes are sums over members.
    """
    below = paths.groupBy("node", "depth").agg(F.min("member").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                               F.max("size").alias("size"), F.max("parent").alias("parent"))
    top = plan.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        root().alias("node"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast("binary").alias("parent"))
    nodes = saved(below.unionByName(top), "trie-nodes")
    owned = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("owned"), F.min("depth").alias("since"))
    members = paths.select("node", "member").unionAll(plan.select(root().alias("node"), F.col("conv_id").alias("member")))
    below = members.join(owned, members.member == owned.conv_id).groupBy("node").agg(F.sum("owned").alias("below"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    n_children = F.coalesce("n_children", F.lit(0).cast("bigint"))
    return (nodes.join(owned.select("conv_id", "since"), "conv_id").join(below, "node").join(children, "node", "left").join(parents, "parent", "left")
            .select("node", "depth", "conv_id", "parent_conv_id", "n_convs", n_children.alias("n_children"),
                    (F.col("below") - (F.col("depth") - F.col("since"))).alias("nodes"),
                    (n_children == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("tokens")))


def rollup(nodes: DataFrame, paths: DataFrame, weights: tuple[str, ...]) -> DataFrame:
    """(node, weight sums over its subtree) by centroid decomposition of the tree.

    ``nodes``: node, depth, conv_id (some member), nodes (in its subtree), weights. ``paths``: (member, depth, node, parent). A component
    has the id of its top node. A node is below the centroid if its conversation's path has a child of the centroid one step deeper.
    """
    zero = F.lit(0).cast("bigint")
    state = saved(nodes.select("node", "depth", "conv_id", F.col("nodes").alias("below"), root().alias("component"), *weights,
                               *(zero.alias(f"sum_{w}") for w in weights)), "components")
    steps = paths.select(F.col("member").alias("conv_id"), (F.col("depth") - 1).alias("z_depth"), F.col("parent").alias("z"), F.col("node").alias("child"))
    done = None
    while state.limit(1).count():
        tops = state.filter("node = component").select("component", F.col("below").alias("total"))
        path = state.select("component", "depth", "node", "below").join(tops, "component").filter("below * 2 > total")
        centroids = path.groupBy("component").agg(F.max("total").alias("total"), F.max(F.struct("depth", "node", "below")).alias("c")).select(
            "component", "total", F.col("c.node").alias("z"), F.col("c.depth").alias("z_depth"), F.col("c.below").alias("z_below"))
        placed = state.join(centroids, "component")
        under = placed.filter("depth > z_depth").select("node", "conv_id", "z", "z_depth").join(
            steps, ["conv_id", "z_depth", "z"]).select("node", "child")
        split = saved(placed.join(under, "node", "left"), "split")
        sums = split.filter("child is not null or node = z").groupBy("component").agg(*(F.sum(w).alias(f"z_{w}") for w in weights))
        on_path = F.col("below") * 2 > F.col("total")
        moved = saved(split.join(sums, "component").select(
            "node", "depth", "conv_id", (F.col("below") - F.when(on_path, F.col("z_below")).otherwise(0)).alias("below"),
            F.coalesce("child", "component").alias("component"), *weights,
            *((F.col(f"sum_{w}") + F.when(on_path, F.col(f"z_{w}")).otherwise(0)).alias(f"sum_{w}") for w in weights),
            (F.col("node") == F.col("z")).alias("done")), "components")
        finished = moved.filter("done").select("node", *(f"sum_{w}" for w in weights))
        done = finished if done is None else done.unionAll(finished)
        state = moved.filter("not done").drop("done")
    return done if done is not None else state.select("node", *(f"sum_{w}" for w in weights))


def end_digests(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """(node, ends_sha256) for nodes at which conversations end.

    Conversation numbers are sorted over all partitions and joined into short pieces there; a digest is read off its pieces in order,
    one at a time. SHA-256 has to see the bytes in sequence, so the pieces of a node go to one task, as a stream.
    """
    ends = paths.filter("ends").select("node", "member").unionAll(
        plan.filter("length = 0").select(root().alias("node"), F.col("conv_id").alias("member")))
    pieces_schema = T.StructType([*fields(ends, "node"), *typed("first bigint, ids binary")])
    digest_schema = T.StructType([*fields(ends, "node"), *typed("ends_sha256 string")])

    def pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        def piece():
            return {"node": node, "first": held[0], "ids": b",".join(str(m).encode() for m in held)}
        for b in batches(rows, 10_000):
            out = []
            for n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (n != node or len(held) == PIECE):
                    out.append(piece())
                    held = []
                node = n
                held.append(m)
            yield pa.RecordBatch.from_pylist(out, pieces_type)
        if held:
            yield pa.RecordBatch.from_pylist([piece()], pieces_type)

    def digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches(rows, 10_000):
            out = []
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h is not None and n == node:
                    h.update(b",")
                else:
                    if h is not None:
                        out.append({"node": node, "ends_sha256": h.hexdigest()})
                    node, h = n, hashlib.sha256()
                h.update(ids)
            yield pa.RecordBatch.from_pylist(out, digest_type)
        if h is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": h.hexdigest()}], digest_type)

    pieces_type = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    digest_type = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    cut = ends.repartitionByRange("node", "member").sortWithinPartitions("node", "member").mapInArrow(pieces, pieces_schema)
    return cut.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(digests, digest_schema)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes with their owner, members, children, and the sums over their subtrees."""
    turns = saved(positions(conversations), "turns")
    plan = saved(heads(turns), "heads")
    paths = saved(prefixes(rebuilt(turns, plan)), "paths")
    nodes = saved(trie(paths, plan), "trie")
    sums = rollup(nodes, paths, ("leaf", "tokens"))
    return nodes.join(sums, "node").join(end_digests(paths, plan), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"),
        F.col("sum_tokens").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit, then every conversation's turns, nodes by their list of turns, and ancestors by the node's own prefixes.
SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS at,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, count(*) AS own, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % {HEAD} AS h FROM t GROUP BY conv_id),
plan AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS k FROM c LEFT JOIN c b ON c.base = b.conv_id),
turns AS (SELECT p.conv_id AS m, t.at AS depth, d, size FROM plan p JOIN t ON t.conv_id = p.base AND t.at <= p.h
  UNION ALL SELECT p.conv_id, t.at - p.h + p.k, d, size FROM plan p JOIN t ON t.conv_id = p.conv_id AND t.at > p.h),
paths AS (SELECT m, depth, size, list(d) OVER w AS path, count(*) OVER (PARTITION BY m) AS length FROM turns WINDOW w AS (PARTITION BY m ORDER BY depth)
  UNION ALL SELECT conv_id, 0, 0, [], (SELECT count(*) FROM turns WHERE m = conv_id) FROM plan),
nodes AS (SELECT path, depth, min(m) AS conv_id, count(*) AS n_convs, max(size) AS size,
    sha256(coalesce(string_agg(m::VARCHAR, ',' ORDER BY m) FILTER (depth = length), '')) AS ends_sha256 FROM paths GROUP BY path, depth),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.path = n.path[1:n.depth - 1] AND n.depth > 0),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT l.*, coalesce(children.n, 0) AS n_children FROM linked l LEFT JOIN children USING (path)),
up AS (SELECT path[1:k] AS top, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * size AS tokens FROM full_nodes, range(0, depth + 1) r(k)),
sums AS (SELECT top AS path, sum(leaf) AS n_leaves, sum(tokens) AS saved_tokens FROM up GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM full_nodes JOIN sums USING (path)
"""
