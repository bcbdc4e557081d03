"""Which documents share a 64-bit key with another one, in one shuffle of about eight bytes a key.

A map task sorts its keys. Keys that two of its documents have are shared, and it says so at once for all of them; to
the other tasks it sends each of its keys once. So however many documents have a key, the task that gathers it gets one
entry per map task. Entries travel as packed, compressed arrays by key range.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, types as T

from codecairn.llm.tables import map_rows, typed

#: Made once a task: a batch -> (nodes, keys, the index in nodes of each key); keys are distinct within a node of the batch.
Keys = Callable[[], Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array by significance, so that equal high bytes lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays (the first one sorted) as one compressed block."""
    first = np.diff(arrays[0], prepend=np.zeros(1, arrays[0].dtype))
    parts = [_planes(a) for a in (first, *arrays[1:])]
    head = np.array([len(arrays), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(block: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    out, at = [], 8 + 8 * n
    for size, kind in zip(sizes, kinds):
        out.append(_from_planes(data[at:at + size], kind))
        at += int(size)
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def shared_keys(docs: DataFrame, columns: list[str], keys_of: Keys, parts: int, hot: int) -> DataFrame:
    """(node, key, n): a row per node and key that some other node has too, n null; and a row per key that more than
    ``hot`` nodes have, node null, with about their number n.

    A node that comes twice with a key in one task counts as two, so that a key may be listed for one node alone.
    """
    sent = T.StructType(typed("part int, block binary, node bigint, key bigint"))

    def collect(rows):
        of = keys_of()
        nodes, keys, at, n = [], [], [], 0
        for b in rows:
            ids, k, i = of(b)
            nodes.append(np.asarray(ids, np.int64))
            keys.append(k)
            at.append((i + n).astype(np.uint32))
            n += len(ids)
        if not n:
            return
        key, index, id_of = np.concatenate(keys), np.concatenate(at), np.concatenate(nodes)
        del keys, at, nodes
        order = np.argsort(key)
        key, index = key[order], index[order]
        runs = groups(key)
        sizes = np.diff(runs)
        local = np.repeat(sizes > 1, sizes)
        hit_nodes, hit_keys = id_of[index[local]], signed(key[local])
        for s in range(0, len(hit_nodes), 50_000):
            n = len(hit_nodes[s:s + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array((hit_nodes[s:s + n] % parts).astype(np.int32)), pa.array([b""] * n, pa.binary()),
                                              pa.array(hit_nodes[s:s + n]), pa.array(hit_keys[s:s + n])], sent.names)
        key, index, sizes = key[runs[:-1]], index[runs[:-1]], np.minimum(sizes, 1 << 30).astype(np.uint32)
        part = (key % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[ends[p]:ends[p + 1]]
            if len(mine):
                used, local_index = np.unique(index[mine], return_inverse=True)
                block = pack(key[mine], local_index.astype(np.uint32), sizes[mine])
                table = id_of[used].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([len(table).to_bytes(8, "big") + table + block], pa.binary()),
                     pa.array([0], pa.int64()), pa.array([0], pa.int64())], sent.names)

    def gather(group):
        """The rows that came as they are, and entries whose key came from two tasks."""
        packed = group["block"].map(len) > 0
        direct = group[~packed]
        nodes, keys, sizes = [], [], []
        for block in group["block"][packed]:
            end = 8 + int.from_bytes(block[:8], "big")
            id_of = np.frombuffer(block[8:end], np.int64)
            k, i, n = unpack(block[end:], np.uint64, np.uint32, np.uint32)
            nodes.append(id_of[i])
            keys.append(k)
            sizes.append(n)
        out = [(direct["node"].to_numpy(np.int64), direct["key"].to_numpy(np.int64))]
        known = np.empty(0, np.int64), np.empty(0, np.int64)
        if nodes:
            node, key, size = np.concatenate(nodes), np.concatenate(keys), np.concatenate(sizes).astype(np.int64)
            order = np.lexsort((node, key))
            node, key, size = node[order], key[order], size[order]
            again = np.zeros(len(key), bool)  # the same node from another task
            again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1]) & (size[1:] == 1) & (size[:-1] == 1)
            node, key, size = node[~again], key[~again], size[~again]
            runs = groups(key)
            single = np.repeat(np.diff(runs) > 1, np.diff(runs)) & (size == 1)
            out.append((node[single], signed(key[single])))
            total = np.add.reduceat(size, runs[:-1])
            known = signed(key[runs[:-1]][total > hot]), total[total > hot]
        node, key = (np.concatenate(c) for c in zip(*out))
        none = np.full(len(node), None), np.full(len(known[0]), None)
        return pd.DataFrame({"node": pd.array(np.concatenate([node, none[1]]), "Int64"), "key": np.concatenate([key, known[0]]),
                             "n": pd.array(np.concatenate([none[0], known[1]]), "Int64")})

    return map_rows(docs, columns, sent, collect).groupBy("part").applyInPandas(gather, "node bigint, key bigint, n bigint")
