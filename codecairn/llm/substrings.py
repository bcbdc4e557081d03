"""Repeated passages: words covered by a window of words that an earlier document also has.

Windows are dealt to shards by content: the key of a window is the least hash of the word 5-grams in it, and consecutive windows of
one key travel as one segment. Only keys that two documents share (``shared_keys``, one small shuffle) are dealt at all. Each
shard builds an FM-index of its distinct segments; backward search over its wavelet matrix gives the matching statistics of every
segment, and the interval of a match at the threshold gives the first document that has the window. Since equal windows
have equal keys, each is decided in one shard, exactly.

Keys in very many documents are split: each of their windows is a segment of its own, dealt by its whole content, and equal
ones are merged before and in the shard, so that no shard grows with the number of documents of a passage.

Rows: one per input row, by its doc_id. A null text has no words; a document whose doc_id is null neither removes nor
loses words; rows with one doc_id do not remove each other's words, and a window counts from the smallest doc_id that has it.
Texts of fewer words than a window lose nothing. Other columns are not read.
"""
from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codecairn.llm.fm_index import FmIndex
from codecairn.llm.shared_keys import shared_keys, signed
from codecairn.llm.tables import fields, map_rows, table, typed
from codecairn.llm.words import blocks, mix, sliding_min, windows, word_bounds, word_hashes
from codecairn.sources.scratch import saved

WINDOW, GRAM = 13, 5
#: Words of a shard before equal segments are merged; documents that make a key a hot one; bytes a task gathers before it sends.
SHARD_WORDS, HOT, FLUSH = 1_500_000, 20_000, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


class Runs:
    """The windows of some texts in runs of equal key: [first, last] windows, key, text."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.words, self.at = word_hashes(texts)
        self.window = window
        doc = np.repeat(np.arange(len(texts)), np.diff(self.at))
        n = len(self.words) - window + 1
        if n < 1:
            self.first = self.last = self.doc = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        gram = min(GRAM, window)
        key = sliding_min(windows(self.words, gram), window - gram + 1)
        valid = doc[:n] == doc[window - 1:]
        start = valid.copy()
        start[1:] &= ~(valid[:-1] & (key[1:] == key[:-1]) & (doc[1:n] == doc[:n - 1]))
        self.first = np.flatnonzero(start)
        stop = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~start[1:], [False]]))
        self.last, self.key, self.doc = stop, key[self.first], doc[self.first]

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the word hashes times powers, and inverse powers; once for all texts of a block."""
        n = len(self.words)
        power, inverse = (np.full(n + 1, base, np.uint64) for base in (_BASE, _INVERSE))
        total = np.zeros(n + 1, np.uint64)
        power[0] = inverse[0] = 1
        power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        np.cumsum(mix(self.words) * power[:n], out=total[1:])
        return total, inverse

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the words of each range of windows, from the running sums."""
        if not len(first):
            return np.empty(0, np.uint64)
        total, inverse = self._sums
        end = last + self.window
        return mix((total[end] - total[first]) * inverse[first] + mix(end - first))


def minimizer_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each text, and the index of the text."""
    keys, index = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in blocks(texts):
        runs = Runs(texts[a:b])
        order = np.lexsort((runs.key, runs.doc))
        key, doc = runs.key[order], runs.doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        keys.append(key[new])
        index.append(doc[new] + a)
    return np.concatenate(keys), np.concatenate(index)


def _keys_by_document():
    def keys_of(batch):
        known = [(n, t.encode()) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if n is not None and t]
        return np.array([n for n, _ in known], np.int64), *minimizer_keys([t for _, t in known])
    return keys_of


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text of every row, as it goes through a shuffle."""
    schema = T.StructType([*fields(docs, "doc_id"), *typed("packed binary")])

    def task(rows):
        z = zstandard.ZstdCompressor(level=3)
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress((t or "").encode()) for t in b.column(1).to_pylist()],
                                                                    pa.binary())], schema.names)

    return map_rows(docs, ["doc_id", "text"], schema, task)


def unpacked(column: pa.Array) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in column.to_pylist()]


def segments(docs: DataFrame, candidates: DataFrame, shards: int) -> DataFrame:
    """Blocks of segments by shard (with the first and the last document of each), and a row per segment and document."""
    lists = candidates.groupBy("node").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))
    joined = packed(docs.filter("doc_id is not null and text is not null")).join(lists, F.col("doc_id") == F.col("node"))
    schema = T.StructType(typed("shard int, block binary, digest bigint, doc bigint"))

    def block(found: dict[bytes, list[int]]) -> bytes:
        ids = np.array([i for pair in found.values() for i in pair], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(len(found).to_bytes(8, "big") + ids + b"\n".join(found))

    def task(rows):
        held: dict[int, dict[bytes, list[int]]] = {}
        size = 0
        for b in rows:
            ids, texts = b.column(0).to_pylist(), unpacked(b.column(1))
            keys, hots = b.column(2).to_pylist(), b.column(3).to_pylist()
            for s, e in blocks(texts):
                joined_text = b"\n".join(texts[s:e])
                starts, ends = word_bounds(joined_text)
                runs = Runs(texts[s:e])
                bounds = np.searchsorted(runs.doc, np.arange(e - s + 1))
                out_digest, out_shard, out_doc = [], [], []
                for i in range(s, e):
                    mine = slice(bounds[i - s], bounds[i - s + 1])
                    key, first, last = signed(runs.key[mine]), runs.first[mine], runs.last[mine]
                    take = np.isin(key, np.array(keys[i], np.int64))
                    hot = np.isin(key, np.array(hots[i], np.int64)) if hots[i] else np.zeros(len(key), bool)
                    single = np.concatenate([np.arange(a, z + 1) for a, z in zip(first[hot], last[hot])]) if hot.any() else first[:0]
                    first, last = np.concatenate([first[take & ~hot], single]), np.concatenate([last[take & ~hot], single])
                    digest = runs.digests(first, last)
                    by = np.concatenate([runs.key[mine][take & ~hot], digest[len(digest) - len(single):]])
                    shard = (mix(by) % np.uint64(shards)).astype(np.int64)
                    for f, z, p in zip(first.tolist(), last.tolist(), shard.tolist()):
                        words = b" ".join(joined_text[starts[f]:ends[z + WINDOW - 1]].split())
                        into = held.setdefault(p, {})
                        span = into.get(words)
                        if span is None:
                            into[words] = [ids[i], ids[i]]
                            size += len(words) + 100
                        else:
                            span[0], span[1] = min(span[0], ids[i]), max(span[1], ids[i])
                    out_digest.append(signed(digest))
                    out_shard.append(shard.astype(np.int32))
                    out_doc.append(np.full(len(digest), ids[i], np.int64))
                digest, shard, doc = map(np.concatenate, (out_digest, out_shard, out_doc))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.nulls(len(doc)).cast(pa.binary()), pa.array(digest), pa.array(doc)],
                                                 schema.names)
                if size > FLUSH:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    def send(held):
        for p, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block(found)], pa.binary()),
                                              pa.nulls(1).cast(pa.int64()), pa.nulls(1).cast(pa.int64())], schema.names)

    return map_rows(joined, ["doc_id", "packed", "keys", "hot"], schema, task)


def first_documents(blocks_of_shard: list[bytes]) -> list[tuple[int, list[int]]]:
    """(digest, the first document of each window) of the segments of one shard that some later document has too."""
    found: dict[bytes, list[int]] = {}
    z = zstandard.ZstdDecompressor()
    for data in map(z.decompress, blocks_of_shard):
        n = int.from_bytes(data[:8], "big")
        ids = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2).tolist()
        for words, (low, high) in zip(data[8 + 16 * n:].split(b"\n"), ids):
            span = found.get(words)
            if span is None:
                found[words] = [low, high]
            else:
                span[0], span[1] = min(span[0], low), max(span[1], high)
    texts = list(found)
    low, high = np.array(list(found.values()), np.int64).reshape(-1, 2).T
    words, at = word_hashes(texts)
    _, symbol = np.unique(words, return_inverse=True)
    n = len(texts)
    # each segment, then a separator
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))
    symbols = np.zeros(len(words) + n, np.int64)
    symbols[place] = symbol + 1
    owner = np.repeat(np.arange(n), np.diff(at) + 1)
    index = FmIndex(symbols)
    starts = at[:-1] + np.arange(n)
    many = np.diff(at) - WINDOW + 1
    segment = np.repeat(np.arange(n), many)
    first = np.repeat(starts, many) + np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many)
    earliest, latest = low[segment].copy(), high[segment].copy()
    by_suffix = owner[index.suffixes]
    low_by, high_by = np.append(low[by_suffix], np.iinfo(np.int64).max), np.append(high[by_suffix], np.iinfo(np.int64).min)
    for s in range(0, len(first), 200_000):
        ends = first[s:s + 200_000] + WINDOW - 1
        length, lo, hi = index.matching_statistics(ends, symbols, WINDOW)
        whole = np.flatnonzero(length == WINDOW)
        if len(whole):
            starts_of, back = np.unique(lo[whole], return_inverse=True)
            stops = np.zeros(len(starts_of), np.int64)
            stops[back] = hi[whole]
            cut = np.stack([starts_of, stops], axis=1).ravel()
            earliest[s + whole] = np.minimum.reduceat(low_by, cut)[::2][back]
            latest[s + whole] = np.maximum.reduceat(high_by, cut)[::2][back]
    runs = Runs(texts)
    digest = signed(runs.digests(at[:-1], at[1:] - WINDOW))
    offsets = np.cumsum(many) - many
    useful = np.flatnonzero(np.minimum.reduceat(earliest, offsets) < high) if n else []
    return [(int(digest[i]), earliest[offsets[i]:offsets[i] + many[i]].tolist()) for i in useful]


def removals(docs: DataFrame) -> DataFrame:
    """(doc, removed): by document, the segments (digest) with the places of their windows that an earlier one has."""
    spark = docs.sparkSession
    parts = max(8, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = saved(shared_keys(docs, ["doc_id", "text"], _keys_by_document, parts, HOT), "shared-keys")
    hot = shared.filter("node is null").select("key", F.lit(True).alias("hot"))
    rows = shared.filter("node is not null").select("node", "key")
    # a segment has (WINDOW - GRAM) / 2 + WINDOW words on average
    shards = max(1, rows.count() * (WINDOW + (WINDOW - GRAM) // 2) // SHARD_WORDS)
    dealt = saved(segments(docs, rows.join(hot, "key", "left"), shards), "segments")

    def index(group):
        found = first_documents(list(group["block"]))
        return pd.DataFrame({"shard": int(group["shard"].iloc[0]), "digest": [f[0] for f in found], "firsts": [f[1] for f in found]})

    indexed = dealt.filter("block is not null").select("shard", "block").groupBy("shard").applyInPandas(
        index, "shard int, digest bigint, firsts array<bigint>")
    owners = dealt.filter("block is null").select("shard", "digest", "doc")
    hit = owners.join(indexed, ["shard", "digest"]).select("doc", "digest", F.expr(
        "filter(sequence(0, size(firsts) - 1), i -> firsts[i] < doc)").alias("places")).filter(F.size("places") > 0)
    return hit.groupBy("doc").agg(F.collect_set(F.struct("digest", "places")).alias("removed"))


def covered(texts: list[bytes], removed: list[list[dict] | None]) -> list[np.ndarray]:
    """Per text, whether each word is to be removed."""
    runs = Runs(texts)
    every = np.arange(max(0, len(runs.words) - WINDOW + 1))
    out = []
    bounds = np.searchsorted(runs.doc, np.arange(len(texts) + 1))
    for i, listed in enumerate(removed):
        a, z = int(runs.at[i]), int(runs.at[i + 1])
        hit = np.zeros(z - a + 1, np.int64)
        if listed and z - a >= WINDOW:
            places = {d["digest"]: d["places"] for d in listed}
            wanted = np.array(list(places), np.int64)
            mine = slice(bounds[i], bounds[i + 1])
            first, last = runs.first[mine], runs.last[mine]
            digest = signed(runs.digests(first, last))
            at = [f - a + p for f, d in zip(first[np.isin(digest, wanted)].tolist(), digest[np.isin(digest, wanted)].tolist()) for p in places[d]]
            single = every[a:z - WINDOW + 1]  # windows that were dealt on their own
            at += (single[np.isin(signed(runs.digests(single, single)), wanted)] - a).tolist()
            at = np.unique(np.array(at, np.int64))
            hit[at] += 1
            hit[at + WINDOW] -= 1
        out.append(np.cumsum(hit[:-1]) > 0)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans of removed words (start, end exclusive), kept text (words joined by a space)."""
    gone = removals(docs.filter("doc_id is not null"))
    joined = packed(docs).join(gone, F.col("doc_id") == F.col("doc"), "left")
    schema = T.StructType([*fields(docs, "doc_id"), *typed(
        "n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string")])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def task(rows):
        for b in rows:
            texts, listed = unpacked(b.column(1)), b.column(2).to_pylist()
            n, removed, spans, kept = [], [], [], []
            for s, e in blocks(texts):
                for text, drop in zip(texts[s:e], covered(texts[s:e], listed[s:e])):
                    words = text.split()
                    n.append(len(words))
                    removed.append(int(drop.sum()))
                    edges = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=0, append=0)).tolist()
                    spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])])
                    kept.append(b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if removed[-1] else words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, spans_type), pa.array(kept, pa.string())], schema.names)

    return map_rows(joined, ["doc_id", "packed", "removed"], schema, task)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
