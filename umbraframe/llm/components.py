"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.common import cut, cut_round, release


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones: then each links to its root. Nodes are counted
    where they lie before any are shuffled."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    `edges` has long columns a and b. In each round every node links its larger neighbours, and then its smaller
    ones, to the smallest node it knows (the large-star and small-star steps), so depth falls fast whatever the
    shape; the rounds end when only stars are left, which the edges themselves show. All steps are joins and minima over the
    edge table: no group is gathered anywhere, minima are combined before they are shuffled, and both sides of a join are
    stored first, so that adaptive execution can split the rows of a hub. Each step is a checkpoint.
    """
    now = cut_round(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.distinct())
        roots = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut_round(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct())
        del both, least, large, roots, small
        release(edges.sparkSession)
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
