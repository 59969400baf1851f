"""Connected components of a table of links, by contraction in rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is one node of its component, the same for all of them.

    In a round each node goes to the least of itself and its neighbours, and links join what their ends went to; links
    within one node go. Nodes are ordered by a hash of theirs, so that a round leaves a fraction of them even of a chain
    whose nodes ascend. A node with very many links is summed before the shuffle, and its joins are split as skewed ones."""
    mixed = lambda c: F.struct(F.xxhash64(F.lit(77), c).alias("h"), F.col(c).alias("v")).alias(c)
    links = links.where("a != b").select(mixed("a"), mixed("b"))
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        goes = written(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
        if found is None:
            found = goes
        else:
            step = goes.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = written(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        of_a, of_b = goes.select(F.col("node").alias("a"), F.col("root").alias("ra")), goes.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = links.join(of_a, "a").join(of_b, "b").where("ra != rb")
        links = written(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if links.isEmpty():
            return found.select("node.v", "root.v").toDF("node", "root")


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """components of more links (a, b) and those that gave known (node, root): only what the links join is gone through again."""
    ends = links.where("a != b").select("a", "b").distinct()
    of = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    rooted = ends.join(of("a"), "a", "left").join(of("b"), "b", "left")
    top = components(rooted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    others = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("root"))
    return written(known.unionByName(others).join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
