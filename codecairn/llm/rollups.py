"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A change has the image of a document before and after it: an insert has no ``before``, a delete no ``after``, a revised
count has both. A batch adds up to one signed row per (source, lang, version) and is written under its own id; writing the
same batch again replaces the same rows, so a repeated or half-failed commit never counts twice. Totals are the sum over batches.

Nulls in source, lang or version are values of their own; null tokens count as 0 tokens of a document; a change without both images
adds nothing; an empty batch commits and changes nothing; a store without a commit has no totals; repeated rows within a batch are separate changes. Groups
whose documents and tokens have come down to 0 are not listed. Other columns are not read.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codecairn.llm.tables import table
from codecairn.sources.scratch import saved, scratch_dir

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs bigint, tokens bigint, batch int"


def image(version: str, tokens: Column) -> Column:
    return F.struct(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                    F.lit(version).alias("version"), tokens.cast("bigint").alias("tokens"))


def no_image() -> Column:
    return F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>")


def delta(changes: DataFrame) -> DataFrame:
    """The signed rows of changes (before, after), summed before and after one small shuffle."""
    signed = changes.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("i")),
                                              F.struct(F.lit(1).alias("sign"), F.col("after").alias("i")))).alias("s"))
    there = signed.filter("s.i is not null").select("s.i.*", "s.sign")
    return there.groupBy(*KEYS).agg(F.sum("sign").cast("bigint").alias("docs"),
                                    F.sum(F.coalesce("tokens", F.lit(0)) * F.col("sign")).cast("bigint").alias("tokens"))


def commit(changes: DataFrame, store: str, batch_id: int) -> None:
    delta(changes).write.mode("overwrite").parquet(f"{store}/batch={int(batch_id)}")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """docs and tokens by source, lang and version over all committed batches."""
    try:
        deltas = spark.read.schema(DELTA).parquet(store)
    except AnalysisException as e:  # nothing was committed yet
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        deltas = spark.createDataFrame([], DELTA)
    summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return summed.filter("docs <> 0 or tokens <> 0")


#: Two tokenizer versions that SQL can count too: words, and runs of letters and digits or single other characters.
WORDS_1 = r"[^\x20\x09-\x0D]+"
WORDS_2 = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
LEAST_WORDS = 50


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under words-1; those not in English are counted again under words-2; short ones are deleted, and come
    back in a later batch; the second batch arrives once more. So the totals cover all documents."""
    counted = saved(table(spark, sf_dir, "documents").select("source", "lang", *(
        F.coalesce(F.regexp_count("text", F.lit(p)).cast("bigint"), F.lit(0)).alias(n) for n, p in (("one", WORDS_1), ("two", WORDS_2)))), "counted")
    store = scratch_dir(spark, "rollups")
    one, two = image("words-1", F.col("one")), image("words-2", F.col("two"))
    other = F.coalesce(F.col("lang") != "en", F.lit(True))
    revised = counted.filter(other).select(one.alias("before"), two.alias("after"))
    now = F.when(other, two).otherwise(one)
    is_short = F.col("one") < LEAST_WORDS
    short = counted.filter(is_short).select(now.alias("before"), no_image().alias("after"))
    again = counted.filter(is_short).select(no_image().alias("before"), now.alias("after"))
    commit(counted.select(no_image().alias("before"), one.alias("after")), store, 0)
    commit(revised, store, 1)
    commit(short, store, 2)
    commit(revised, store, 1)
    commit(again, store, 3)
    commit(short, store, 2)
    return totals(spark, store)


SQL = rf"""
WITH counted AS (
  SELECT source, lang, coalesce(lang <> 'en', true) AS other,
    coalesce(len(regexp_extract_all(text, '{WORDS_1}')), 0) AS one, coalesce(len(regexp_extract_all(text, '{WORDS_2}')), 0) AS two
  FROM documents)
SELECT source, lang, CASE WHEN other THEN 'words-2' ELSE 'words-1' END AS version, count(*) AS docs,
  CAST(sum(CASE WHEN other THEN two ELSE one END) AS BIGINT) AS tokens
FROM counted GROUP BY 1, 2, 3
"""
