"""SpotSigs fingerprints of documents, with DataFrame operations only.

A spot is a common word (an anchor) with the chain of the next content words after it, anchors skipped; the fingerprint of a text
is the set of its spots, as sorted 64-bit hashes. Words are runs of letters and digits in lower case. What stands between two
anchors can be replaced without touching other spots, and lists or navigation without common words leave none.
Fingerprints are compared by Jaccard. Sets are dealt to classes by length; with a least likeness, sets in classes further apart
than one cannot reach it and are not intersected.

The query compares every document with an edited version (its last half is replaced by the beginning of the next document,
in descending doc_id) and with that next document.

Rows: one per input row. A null text is empty; a text without words has the empty fingerprint; a text with words but
without a whole chain has one hash of all its words. Two empty fingerprints are alike (1.0). A null doc_id comes after
all others; of rows with one doc_id the order is that of a digest of the text; repeated rows stand at one place of the order
and have equal results. A single document is its own successor. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codecairn.llm.tables import table
from codecairn.sources.scratch import saved

#: Common words of English, French, German and Spanish.
ANCHORS = tuple(("the of and to a in is that it for on was as with by this are be or an at from not have "
                 "le la les de des du et un une est que qui dans en pour pas sur au par "
                 "der die das und ein eine ist den von zu mit nicht auf im dem sich "
                 "el los las y se por con para del lo su al como").split())
#: Content words in a chain, and steps from one of them to the next.
CHAIN, DISTANCE = 3, 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, distance: int = DISTANCE) -> Column:
    """The sorted distinct spots of a text.

    The content words are one array. The j-th anchor (from 0) at word i has i - j content words before it, so its chain begins at
    i - j there. Chains that the text ends are no spots; as i - j never falls, they are the last ones.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        at = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(*anchors), i)))
        return let(F.struct(w.alias("w"), at.alias("at"), F.filter(w, lambda x: ~x.isin(*anchors)).alias("c")), spots)

    def spots(s: Column) -> Column:
        c, w = s["c"], s["w"]
        whole = F.filter(s["at"], lambda i, j: i - j + (chain - 1) * distance < F.size(c))
        hashes = F.transform(whole, lambda i, j: F.xxhash64(F.get(w, i), *(F.get(c, i - j + k * distance) for k in range(chain))))
        return let(F.sort_array(F.array_distinct(hashes)), lambda h: F.when((F.size(h) > 0) | (F.size(w) == 0), h).otherwise(F.array(F.xxhash64(w))))

    return let(words, of_words)


def as_text(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.hex(h))), ",")


def length_class(signatures: Column, least: float) -> Column:
    """Sets whose classes are more than one apart have lengths further apart than a likeness of ``least`` allows."""
    return F.floor(F.log(F.size(signatures).cast("double")) / -log(least))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without intersecting them where length classes exclude ``least``."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b)
    exact = F.when(both == 0, 1.0).otherwise(let(common, lambda n: n / (both - n)))
    if not least:
        return exact
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    apart = F.abs(length_class(a, least) - length_class(b, least)) > 1
    return F.when(~empty & apart, 0.0).otherwise(exact)


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of (doc_id, text); never null, so that joins need not test it first."""
    return F.coalesce(F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text), 256)), F.lit(b""))


def successors(rows: DataFrame) -> DataFrame:
    """(doc_id, key) with the key and length of the document before it, in descending doc_id; the first follows the last.

    Distinct rows are ranked by a range-partitioned sort and offsets by partition; no task sees them all.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").asc()]
    placed = saved(rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), "document-order")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = saved(placed.withColumn("part", part).join(sizes.select("part", before.alias("before")), "part").select(
        "doc_id", "key", "n_chars", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank")), "document-ranks")
    n = ranked.count()
    earlier = ranked.select((F.col("rank") + 1).alias("rank"), F.col("key").alias("earlier_key"), F.col("n_chars").alias("earlier_chars"))
    earlier = earlier.withColumn("rank", F.when(F.col("rank") == n, F.lit(0)).otherwise(F.col("rank")))
    return ranked.join(earlier, "rank").select("doc_id", "key", "earlier_key", "earlier_chars")


def half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the edited text's digest, both fingerprints, and the likeness to the edited text and to the next document.

    Texts go by the key of their row to where their place in the order is known; from there only the part that the document
    before needs, and the signatures, go on to it. Signatures are computed on either side, which costs less than to shuffle them.
    """
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", text.alias("text"), row_key(F.col("doc_id"), text).alias("key"))
    order = saved(successors(whole.select("doc_id", "key", F.length("text").alias("n_chars"))), "successors")
    placed = whole.select("key", "text").join(order, "key")
    moved = placed.select(F.col("earlier_key").alias("key"), F.substring("text", F.lit(1), half(F.col("earlier_chars"))).alias("beginning"),
                          signatures(F.col("text")).alias("next_signatures"))
    following = moved.groupBy("key").agg(F.first("beginning").alias("beginning"), F.first("next_signatures").alias("next_signatures"))
    both = placed.join(following, "key")
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - half(n)), F.col("beginning"))
    cut = both.select("doc_id", n.cast("bigint").alias("n_chars"), "text", "next_signatures", edited.alias("edited"))
    # a generator's output is a column: nothing that stands on it computes the signatures again
    made = cut.select("doc_id", "n_chars", "next_signatures", F.inline(F.array(F.struct(
        F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("signatures"),
        signatures(F.col("edited")).alias("edited_signatures")))))
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("signatures")).alias("fingerprint"),
                       as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
                       likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
                       likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
                       F.size("signatures").cast("bigint").alias("n_signatures"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
