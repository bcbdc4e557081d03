"""What each filter removes in every order of filters: kept, removed, redundant and lost documents per step.

A document is reduced to the set of filters that it fails (a bit mask), documents to counts by (part, mask): the mask cells. A
recursive query starts from the empty prefix of each part and extends it with every filter not yet in it; the bits applied
so far are carried along and find, in the cells, the figures of the step. So an order costs nothing but its prefixes: with five
filters 325 rows a part, whatever the number of documents.

Rows of ``documents``: null and empty texts are empty texts and equal to each other; a null source and an empty one are the part ''.
Repeated rows are documents of their own; E compares doc_ids, so rows of one doc_id never fail it by each other, and
a null doc_id is neither smaller nor larger than any. A document that several rows of ``labels`` name is good (toxic)
if one of them says so. Other columns are not read. An empty table has no parts and gives no rows.
"""
from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codecairn.llm.tables import table
from codecairn.sources.scratch import saved

#: Limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
FILTERS = "ABCDE"
SPACES = " \t\n\x0b\f\r"
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def bits(conditions: list[Column]) -> Column:
    """Bit i is set where condition i holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)))


def text_fails(text: Column) -> Column:
    """The bits of A to D, which depend on the text alone."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    return bits([n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT,
                 F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("bigint") > F.length(text) * F.lit(MOST_CAPITALS).cast("bigint"),
                 text.rlike("[#$%&*|]")])


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask) with ``n``, ``good`` and ``toxic`` documents.

    Texts are read once and stay where they are; their digests are shuffled. Copies are counted by (text, part, labels) before
    they meet, so a text that a third of all documents share is a few rows by then.
    """
    text = F.coalesce("text", F.lit(""))
    facts = saved(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                              F.unhex(F.sha2(text, 256)).alias("digest"), text_fails(text).alias("mask")), "filter-facts")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = facts.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    by_doc = marked.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    copies = saved(by_doc.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")), "copies")
    least = copies.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    unlike = F.coalesce("unnamed", F.lit(0)) + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = copies.join(least, "digest").select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), unlike.alias("n")),
        F.struct(F.col("mask").bitwiseOR(1 << FILTERS.index("E")).alias("mask"), (F.col("n") - unlike).alias("n")))))
    return split.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def steps(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, applied, letter, bit) with the figures of applying that filter after those in ``applied``."""
    moves = [(a, f, 1 << i) for a in range(1 << len(filters)) for i, f in enumerate(filters) if not a >> i & 1]
    move = F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(f).alias("letter"), F.lit(b).alias("bit")) for a, f, b in moves))
    m, a, b = F.col("mask"), F.col("applied"), F.col("bit")
    before, fails = m.bitwiseAND(a) == 0, m.bitwiseAND(b) != 0
    figures = [(before & ~fails, "n"), (before & fails, "n"), (~before & fails, "n"), (m == b, "n"), (before & fails, "good"), (before & fails, "toxic")]
    return cells.select("*", F.inline(move)).groupBy("part", "applied", "letter", "bit").agg(
        *(F.sum(F.when(c, F.col(x)).otherwise(0)).alias(k) for k, (c, x) in zip(METRICS, figures)))


WALK = """
WITH RECURSIVE walk(part, prefix, step, letter, applied, {names}) AS (
  SELECT DISTINCT part, '', 0, '', 0, {zeros} FROM {{steps}}
  UNION ALL
  SELECT s.part, concat(w.prefix, s.letter), w.step + 1, s.letter, w.applied | s.bit, {values}
  FROM walk w JOIN {{steps}} s ON w.part = s.part AND w.applied = s.applied)
SELECT * FROM walk LIMIT ALL
""".format(names=", ".join(METRICS), zeros=", ".join("CAST(0 AS BIGINT)" for _ in METRICS), values=", ".join(f"s.{m}" for m in METRICS))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of all filters, and step; ``shapley`` sums what the step's filter removes over all orders."""
    spark, size = cells.sparkSession, len(filters)
    walk = saved(spark.sql(WALK, steps=saved(steps(cells, filters), "filter-steps")).filter("step > 0"), "filter-walk")
    orders = walk.filter(F.col("step") == size).select("part", F.col("prefix").alias("filter_order"), F.explode(
        F.sequence(F.lit(1), F.lit(size))).alias("at"))
    ways = F.element_at(F.array(*(F.lit(factorial(size - k)) for k in range(1, size + 1))), F.col("step"))
    shapley = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    prefixes = orders.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("at"))).drop("at")
    return prefixes.join(walk, ["part", "prefix"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", *METRICS, "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
    WHEN 'A' THEN len(w) < {LEAST_WORDS} WHEN 'B' THEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w)
    WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t)
    WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(w.doc_id > first, false) END) AS fails
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE NOT contains(o, x)),
placed AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k] AS x, string_split(o[1:k - 1], '') AS done FROM orders, range(1, 6) r(k) WHERE length(o) = 5),
figures AS (SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT list_contains(fails, x) AND NOT list_has_any(fails, done) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN list_contains(fails, x) AND NOT list_has_any(fails, done) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(fails, x) AND list_has_any(fails, done) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [x] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(fails, x) AND NOT list_has_any(fails, done) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(fails, x) AND NOT list_has_any(fails, done) THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, placed GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM figures
"""
