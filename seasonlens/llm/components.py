"""Connected components of an edge table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlens.llm.common import staged, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step points a node's neighbours at the
    smallest of them, so paths halve and the table never grows.  Each round is written to the shared folder and replaces the one before;
    rounds end when every node points at one other that points at none, which is its component's smallest.  The result is staged.  Loops and NULLs are left out.
    """
    lo, hi = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    now = staged(edges.where(F.col(a) != F.col(b)).select(hi.alias("v"), lo.alias("u")).distinct(), "edges")
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("nodes")).first()
        roots_only = state["n"] == state["nodes"]  # every node points at one other
        if roots_only and now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            pointed = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
            roots = now.select(F.col("u").alias("node"), F.col("u").alias("component"))
            found = staged(pointed.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")), "components")
            unstage(now)
            return found
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), F.least("v", "m").alias("m"))
        large = both.join(least, F.col("v") == F.col("k")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u <> v").distinct()
        below = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        small = large.join(below, F.col("v") == F.col("k"))
        moved = small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            below.select(F.col("k").alias("v"), F.col("m").alias("u")))
        before, now = now, staged(moved.where("u <> v").distinct(), "edges")
        unstage(before)
