"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; none gets more than ``MOST`` times what
it has, the excess goes to the others by weight.

Rates: within a source the rates r of its documents minimise sum(r ln r - r) under sum(size * r) = target and r <= MOST.
The dual has one multiplier per source, and r = min(MOST, exp(multiplier * size)). Newton's method solves it for all sources at
once; an iteration is one aggregation over (source, size, documents). All sums are over integers (rates have 30 binary
digits), so that neither the order of rows nor the number of partitions changes a digit and reruns agree.

Rounding: a document gets floor(r) copies, and one more if hash / fraction(r) is below a cut of its source. The cut is found
digit by digit from histograms, so that the words taken come within about a document of the target.

Rows: one per input row. Null and empty texts have size 0 and take nothing; a null source is a source; repeated rows are
separate documents (equal ones share their hash and hence their copies); a null doc_id is a value like others.
A source without words has target 0. Other columns are not read by ``mix_plan``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codecairn.llm.tables import table
from codecairn.sources.scratch import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Relative error at which Newton's method stops, and the iterations after which it does so anyway (bisection halves the rest).
TOLERANCE, ITERATIONS = 1e-6, 60
#: Binary digits of rates; digits of a rounding key, in levels of ``LEVEL_BITS``.
RATE_BITS, LEVEL_BITS, LEVELS = 30, 10, 3
#: Up to so many sources, their parameters are sent to every task; beyond, they are joined by source.
SENT_SOURCES = 10_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def by_source(left: DataFrame, right: DataFrame, how: str = "left", few: bool = False) -> DataFrame:
    """``left`` with the columns that ``right`` has for its source, where null equals null."""
    r = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(r) if few else r, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of each source from 0: a range-partitioned sort, then offsets by partition. No task sees all sources."""
    order = F.col("source").asc_nulls_last()
    placed = saved(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn(
        "_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(
        "rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def with_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``. Each round fixes the sources at their limit; only sums reach the driver."""
    at = F.pmod("rank", F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (at + 1).cast("int"))
    weighed = saved(ranked(sources).withColumn("weight", weight), "weights")
    limit = F.col("source_size") * MOST
    level, full = 0.0, -1
    while True:
        above = limit < F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        total, fixed, weights, now = weighed.agg(
            F.sum("source_size"), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if now == full or not weights:
            break
        full, level = now, ((total or 0) - (fixed or 0)) / weights
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def rate(size: Column, lam: Column, scale: Column) -> Column:
    """min(MOST, exp(lam * size / scale)) with ``RATE_BITS`` binary digits, as an integer."""
    return F.floor(F.least(F.lit(float(MOST)), F.exp(F.least(lam * size / scale, F.lit(2.0)))) * float(1 << RATE_BITS)).cast("bigint")


def multipliers(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``scale`` (the mean size) and ``lam``, the solution of the dual.

    Newton steps that leave the bracket in which the solution is known to be are replaced by its middle.
    """
    hist = saved(sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    ratio = F.log(F.col("target") / F.col("source_size"))
    state = saved(by_source(targets.filter("source_size > 0 and target > 0"), mean).select(
        "source", "source_size", "target", "scale", F.lit(0.0).alias("lam"),
        F.least(F.lit(-1e-9), ratio * F.col("scale")).alias("low"), (F.log(F.lit(float(MOST))) * F.col("scale") + 1e-9).alias("high"),
        F.lit(False).alias("done")), "newton")
    one = float(1 << RATE_BITS)
    r = rate(F.col("size"), F.col("lam"), F.col("scale"))
    mass = F.col("size").cast("decimal(12,0)") * F.col("n").cast("decimal(12,0)")
    for _ in range(ITERATIONS):
        terms = by_source(hist, state, "inner").withColumn("r", r).withColumn("mass", mass)
        slope = F.when(F.col("r") < MOST << RATE_BITS, F.col("mass") * F.col("r").cast("decimal(12,0)") * F.col("size").cast("decimal(12,0)"))
        sums = terms.groupBy("source").agg(F.sum((F.col("mass") * F.col("r").cast("decimal(12,0)")).cast("decimal(38,0)")).alias("got"),
                                           F.sum(slope.cast("decimal(38,0)")).alias("slope"))
        got, gradient = F.col("got").cast("double") / one, F.col("slope").cast("double") / one / F.col("scale")
        over = got > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - (got - F.col("target")) / gradient
        done = F.abs(got - F.col("target")) <= F.col("target") * TOLERANCE
        moved = by_source(state, sums).select("source", "source_size", "target", "scale", "lam", low.alias("low"), high.alias("high"),
                                              done.alias("done"), step.alias("step"))
        inside = F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise(
            (F.col("low") + F.col("high")) / 2)
        state = saved(moved.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(inside)).drop("step"), "newton")
        if not state.filter(~F.col("done")).limit(1).count():
            break
    return by_source(targets, state.select("source", "scale", "lam"))


def _rounding(size: Column) -> tuple[Column, Column]:
    """Whole copies, and the rounding key: a 30-digit integer that falls as the fraction of the rate rises."""
    r = F.when(size > 0, rate(size, F.col("lam"), F.col("scale"))).otherwise(0)
    whole = F.shiftright(r, RATE_BITS)
    fraction = r.bitwiseAND((1 << RATE_BITS) - 1) / float(1 << RATE_BITS)
    draw = (F.pmod(F.xxhash64("doc_id", "source", size), F.lit(1 << 40)) + 1) / float(1 << 40)
    key = F.when(fraction > 0, F.floor(draw / (draw + fraction) * float((1 << LEVEL_BITS * LEVELS) - 1)).cast("bigint"))
    return F.coalesce(whole, F.lit(0)).cast("bigint").alias("whole"), key.alias("key")


def cuts(sized: DataFrame, params: DataFrame) -> DataFrame:
    """(source, cut): documents whose key is below get one more copy.

    Level by level, the histogram of the next digits shows in which bin the words wanted are reached, up to
    1024 bins a source.
    """
    keyed = saved(by_source(sized, params).select("source", "size", "target", *_rounding(F.col("size"))), "rounding")
    state = keyed.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("wanted")).select(
        "source", "wanted", F.lit(0).cast("bigint").alias("prefix"))
    open_keys = keyed.filter("key is not null and size > 0")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        here = by_source(open_keys, state, "inner").filter(F.shiftright("key", shift + LEVEL_BITS) == F.col("prefix"))
        bins = here.groupBy("source", "wanted", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        reached = bins.withColumn("run", run).filter(F.col("run") > F.col("wanted"))
        found = reached.groupBy("source").agg(F.min(F.struct("bin", (F.col("wanted") - F.col("run") + F.col("words")).alias("rest"),
                                                             "words")).alias("b"))
        last = level == LEVELS - 1
        state = saved(found.select("source", F.col("b.rest").alias("wanted"), F.col("b.bin").alias("prefix"),
                                   *([F.col("b.words").alias("words")] if last else [])), "cuts")
    nearer = (F.col("wanted") * 2 > F.col("words")).cast("bigint")  # the last bin goes in if that comes nearer
    return state.select("source", (F.col("prefix") + nearer).alias("cut"))


def mix_plan(sized: DataFrame) -> DataFrame:
    """A row per source: source_size, target, scale, lam, cut (null: the whole of it). Input: doc_id, source, size."""
    sized = saved(sized.select("doc_id", "source", "size"), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    params = saved(multipliers(sized, with_targets(sources)), "multipliers")
    return saved(by_source(params, cuts(sized, params)), "mix")


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows (with doc_id, source, size) with the columns of the plan and ``copies``.

    A plan of at most ``SENT_SOURCES`` rows goes to every task; a larger one is joined by source, where Spark splits
    the source that holds many rows.
    """
    few = plan.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES
    whole, key = _rounding(F.col("size"))
    extra = F.coalesce((key < F.coalesce("cut", F.lit(1 << 62))).cast("bigint"), F.lit(0))
    return by_source(sized, plan, few=few).withColumn("copies", whole + extra)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    sized = docs.select("doc_id", "source", n_words().alias("size"))
    sized = saved(sized, "sizes-of-documents")
    return with_copies(sized, mix_plan(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: the same columns, a row per copy."""
    names = docs.columns
    plan = mix_plan(docs.select("doc_id", "source", n_words().alias("size")))
    row = docs.select("doc_id", "source", n_words().alias("size"), F.struct(*names).alias("_row"))
    copies = with_copies(row, plan).filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "copies")))
    return copies.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
