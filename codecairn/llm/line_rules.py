"""Quality rules on documents, and lines that too many documents of a host repeat.

Base figures come from the text alone. Lines are normalised (lower case, white space collapsed), hashed, and counted
by host (``source``) over distinct documents; exact copies of a text are one document there, since else a page that is copied
often would lose every line, and with it all its copies. A line in more documents than the limit of its host is removed; a
document that loses most of its words is rejected.

Rows: one per input row. Null or empty texts have no words and fail the base rule; documents without a source form a
host of their own; a null doc_id is passed through; repeated rows are judged alike; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codecairn.llm.tables import fields, map_rows, table, typed
from codecairn.llm.words import SPACES, blocks, windows, word_hashes
from codecairn.sources.scratch import discard, saved

SYMBOLS = "#*$%&|<>"
#: A document below this many words, or with more than this percentage of repeated words, fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line may be in this share of a host's documents, and always in this many.
LINE_DOCS, LINE_SHARE = 5, 0.05
#: A document keeps at least this share of its words, or it is rejected.
LEAST_KEPT = 0.5
#: Common lines that are sent to every task at once.
SENT_LINES = 200_000


def line_hash(line: bytes) -> int:
    """Signed 64 bits of the normalised line; the line has a word."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.decode().lower().encode().split()))
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: np.ndarray, size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the document."""
    w = windows(words, size)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def profiles(docs: DataFrame) -> DataFrame:
    """A row per document: base figures, a key of its text, its distinct lines with their words. No shuffle."""
    schema = T.StructType([*fields(docs, "doc_id"), *typed(
        "host string, row_id bigint, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, lines array<struct<line:bigint,words:int>>")])
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))

    def figures(text: str | None, data: bytes, words: np.ndarray):
        text = text or ""
        seen: set[bytes] = set()
        lines: dict[int, int] = {}
        again = 0
        for line in data.split(b"\n"):
            n = len(line.split())
            if n:
                again += line in seen
                seen.add(line)
                h = line_hash(line)
                lines[h] = lines.get(h, 0) + n
        chars = len(text) - sum(text.count(chr(c)) for c in SPACES)
        return (len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words),
                [{"line": h, "words": n} for h, n in lines.items()])

    def task(rows):
        row = TaskContext.get().partitionId() << 40
        for b in rows:
            texts = b.column(2).to_pylist()
            data = [(t or "").encode() for t in texts]
            out = []
            for first, end in blocks(data):
                hashes, at = word_hashes(data[first:end])
                out += [figures(texts[i], data[i], hashes[at[i - first]:at[i - first + 1]]) for i in range(first, end)]
            keys = [None if t is None else xxhash.xxh3_64_intdigest(d) - (1 << 63) for t, d in zip(texts, data)]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(range(row, row + len(texts)), pa.int64()), pa.array(keys, pa.int64()),
                 *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], line_type)], schema.names)
            row += len(texts)

    return map_rows(docs, ["doc_id", "source", "text"], schema, task)


def common_lines(profile: DataFrame, docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(host, line) above the limit. Distinct texts are counted in two steps, both combined before their shuffle."""
    hosts = profile.groupBy("host").agg(F.countDistinct("text_key").alias("host_docs"))
    limits = hosts.select("host", F.greatest(F.lit(docs), F.ceil(F.col("host_docs") * share)).alias("most"))
    lines = profile.select("host", "text_key", F.explode("lines.line").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.countDistinct("text_key").alias("line_docs")).filter(F.col("line_docs") > docs)
    c, m = counts.alias("c"), limits.alias("m")
    return c.join(m, F.col("c.host").eqNullSafe(F.col("m.host")) & (F.col("line_docs") > F.col("most"))).select("c.host", "c.line")


def removed(profile: DataFrame, common: DataFrame) -> DataFrame:
    """(row_id, lines to remove, words they have): one row per document that has a common line."""
    p = profile.select("row_id", "host", F.inline("lines")).alias("p")
    c = common.alias("c")
    hit = p.join(c, (F.col("p.line") == F.col("c.line")) & F.col("p.host").eqNullSafe(F.col("c.host")))
    return hit.groupBy("row_id").agg(F.sum("words").alias("removed_words"), F.collect_list("p.line").alias("removed_lines"))


def judged(docs: DataFrame, line_docs: int = LINE_DOCS, share: float = LINE_SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """``profiles`` with base_failed, removed_words, removed_lines (null where none) and the verdict ``kept``."""
    profile = saved(profiles(docs), "line-profiles")
    gone = removed(profile, common_lines(profile, line_docs, share))
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > n * MOST_REPEATED)
    left = n - F.coalesce("removed_words", F.lit(0))
    return (profile.drop("lines").join(gone, "row_id", "left").withColumn("base_failed", failed)
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
            .withColumn("kept", ~failed & (left >= n * least_kept)))


def clean(docs: DataFrame, line_docs: int = LINE_DOCS, share: float = LINE_SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The documents that pass, with the columns they had, without their common lines.

    The common lines of a host are at most (mean lines of its texts) / ``share``. They go to the tasks by blocks of hosts with up to
    ``SENT_LINES`` together, and each row is judged where it lies: no text is shuffled, and hosts with no common line are a block too.
    """
    spark, names = docs.sparkSession, docs.columns
    profile = saved(profiles(docs).select("host", "text_key", "lines"), "line-profiles")
    common = saved(common_lines(profile, line_docs, share), "common-lines")
    discard(profile)
    blocks_of_hosts = max(1, -(-common.count() // SENT_LINES))
    block = F.pmod(F.xxhash64("host"), F.lit(blocks_of_hosts))
    kept = None
    for k in range(blocks_of_hosts):
        lines: dict[str | None, set[int]] = {}
        for r in common.filter(block == k).toLocalIterator():
            lines.setdefault(r["host"], set()).add(r["line"])
        here = docs.filter(F.pmod(F.xxhash64(F.col("source").cast("string")), F.lit(blocks_of_hosts)) == k) if blocks_of_hosts > 1 else docs
        part = _cleaned(here, names, spark.sparkContext.broadcast(lines), least_kept)
        kept = part if kept is None else kept.unionAll(part)
    return kept


def _cleaned(docs: DataFrame, names: list[str], sent, least_kept: float) -> DataFrame:
    def judge(text: str, words: np.ndarray, gone: set[int]) -> str | None:
        """The text without its common lines; None if it fails the base rules or too little is left."""
        n = len(words)
        if n < LEAST_WORDS or repeated_words(words) * 100 > n * MOST_REPEATED:
            return None
        if not gone:
            return text
        lines = text.split("\n")
        is_gone = [bool(x.encode().split()) and line_hash(x.encode()) in gone for x in lines]
        lost = sum(len(x.encode().split()) for x, g in zip(lines, is_gone) if g)
        if n - lost < n * least_kept:
            return None
        return "\n".join(x for x, g in zip(lines, is_gone) if not g) if lost else text

    def task(rows):
        for b in rows:
            columns = {n: b.column(i) for i, n in enumerate(names)}
            texts, hosts = columns["text"].to_pylist(), columns["source"].to_pylist()
            data = [(t or "").encode() for t in texts]
            new = []
            for first, end in blocks(data):
                hashes, at = word_hashes(data[first:end])
                new += [judge(texts[i] or "", hashes[at[i - first]:at[i - first + 1]],
                              sent.value.get(None if hosts[i] is None else str(hosts[i]), ())) for i in range(first, end)]
            stay = pa.array([t is not None for t in new], pa.bool_())
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                n = [k if t is None or t == old else len(t) for k, t, old in zip(columns["n_chars"].to_pylist(), new, texts)]
                columns["n_chars"] = pa.array(n, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n].filter(stay) for n in names], names)

    return map_rows(docs, names, T.StructType(fields(docs, *names)), task)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM d),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY r),
lines AS (SELECT r, source, text, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
again AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
norm AS (SELECT r, source, text, lower(array_to_string(w, ' ')) AS l, len(w) AS n FROM lines),
hosts AS (SELECT source, greatest({LINE_DOCS}, ceil(count(DISTINCT text) * {LINE_SHARE})) AS most FROM d GROUP BY source),
common AS (SELECT c.source, l FROM (SELECT source, l, count(DISTINCT text) AS n FROM norm GROUP BY source, l) c
  JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source AND c.n > h.most),
gone AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM norm JOIN common c ON norm.l = c.l AND norm.source IS NOT DISTINCT FROM c.source GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols, coalesce(again.n, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN again USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= n_words * {LEAST_KEPT} AS kept, removed_words
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
"""
