"""Byte-level BPE: merges by a priority queue over a linked list of symbols; decoding by concatenation.

Result of ``token_digests``: a row per input row with doc_id, n_tokens, ids_sha256, decoded_sha256.
A null text counts as empty (0 tokens, digests of the empty string). doc_id is passed through as it
is: nulls, ties and repeated rows stay, each row is encoded by itself. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, types as T

from codecairn.llm.tables import fields, map_rows, table, typed

#: Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers in each of two generations, about 26 MB in all, which it keeps for as long as it lives; results do not depend on it.
REMEMBERED = 100_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary, from the text of its JSON file."""

    def __init__(self, text: str):
        data = json.loads(text)
        vocab, letters = data["model"]["vocab"], byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.letter_ids = [vocab[c] for c in letters]
        #: left << 20 | right -> rank, and the id of the merged symbol by rank
        self.rank_of: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(
            map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(SPLIT).findall
        #: Ids of pieces seen lately, and of those seen before them.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: the pair of lowest rank, leftmost first, merges until no pair is left.

        A queue entry is rank << 32 | place of the left symbol; ``now`` has the rank of the pair that
        starts at each place at present, so that an entry with another rank is stale.
        """
        letter_ids, rank_of, merged = self.letter_ids, self.rank_of, self.merged
        symbols = [letter_ids[b] for b in piece]
        n = len(symbols)
        now = [rank_of.get(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
        queue = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return tuple(symbols)
        heapify(queue)
        now.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            rank = entry >> 32
            if now[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbols[i] = s = merged[rank]
            symbols[j] = now[j] = -1
            if k < n:
                before[k] = i
                r = now[i] = rank_of.get(s << 20 | symbols[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = now[h] = rank_of.get(symbols[h] << 20 | s, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        return tuple([s for s in symbols if s >= 0])

    def _ids_of(self, piece: str) -> tuple[int, ...]:
        got = self.older.get(piece) or self.merge(piece.encode())
        if len(piece) < 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[piece] = got
        return got

    def _plain(self, text: str, ids: list[int]) -> None:
        for piece in self.pieces(text):
            ids += self.known.get(piece) or self._ids_of(piece)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self.special_pattern is None:
            self._plain(text, ids)
            return ids
        for part in self.special_pattern.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                self._plain(part, ids)
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(text: str) -> Bpe:
    return Bpe(text)


def _shared(spark: SparkSession, path: str):
    """The vocabulary file (a few MB, whatever the input), read here and sent to the executors."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The input rows with a list of token ids instead of the text."""
    keep = [c for c in docs.columns if c not in (text, ids)]
    vocabulary = _shared(docs.sparkSession, path)

    def task(rows):
        bpe = _loaded(vocabulary.value)
        for b in rows:
            found = pa.array([bpe.encode(t or "") for t in b.column(len(keep)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*keep, ids])

    return map_rows(docs, [*keep, text], T.StructType([*fields(docs, *keep), *typed(f"{ids} array<int>")]), task)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The input rows with the decoded text instead of the ids; null ids give an empty text."""
    keep = [c for c in tokens.columns if c not in (text, ids)]
    vocabulary = _shared(tokens.sparkSession, path)

    def task(rows):
        bpe = _loaded(vocabulary.value)
        for b in rows:
            found = pa.array([bpe.decode(x or []) for x in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*keep, text])

    return map_rows(tokens, [*keep, ids], T.StructType([*fields(tokens, *keep), *typed(f"{text} string")]), task)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes in one pass, so that ids never leave the task."""
    vocabulary = _shared(docs.sparkSession, path)
    schema = T.StructType([*fields(docs, "doc_id"), *typed("n_tokens bigint, ids_sha256 string, decoded_sha256 string")])

    def task(rows):
        bpe = _loaded(vocabulary.value)
        for b in rows:
            n, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_text, pa.string())], schema.names)

    return map_rows(docs, ["doc_id", "text"], schema, task)


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())
