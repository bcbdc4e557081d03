"""Connected components by contraction, for graphs of any shape and size."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codecairn.sources.scratch import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of a component share a root, which is one of them.

    Each round every node joins the neighbour (or itself) of least hash, edges are renamed to these and loops dropped. The hash
    changes with the round, so a chain shrinks by a constant factor whatever its ids. Minima are combined before the
    shuffle, which suits nodes with very many edges. Every round's tables are written, so lineage stays short.
    """
    edges = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    roots = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    k = 0
    while edges.limit(1).count():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        joins = saved(least.select(F.col("a").alias("old"), F.least("m", order("a")).getField("v").alias("new")), "joins")
        roots = saved(roots.join(joins, roots.root == joins.old, "left").select(
            "node", F.coalesce("new", "root").alias("root")), "roots")
        first = edges.join(joins, edges.a == joins.old).select(F.col("new").alias("a"), "b")
        renamed = first.join(joins, first.b == joins.old).select(F.col("a"), F.col("new").alias("b"))
        edges = saved(renamed.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        k += 1
    return roots
