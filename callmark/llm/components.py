"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long).  node, component (the least node that can be reached) for every node of a link.

    Each round every node points to the one of least hash among its neighbours and itself, and on to where that one
    points; links are carried over to those nodes, and what lies within one node or is double goes.  So the links
    shrink by a factor each round, whatever their shape, and most go in the first.  A node with many links is reduced
    before the shuffle.  At last the rounds are followed back, and each set gets its least node.
    """
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    rounds = []
    while not links.isEmpty():
        own, other = (F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node")) for c in "ab")
        least = F.least(own, other).alias("least")
        ends = links.select(F.explode(F.array("a", "b")).alias("node"), least)
        points = ends.groupBy("node").agg(F.min("least")["node"].alias("to"))
        further = points.select(F.col("node").alias("to"), F.col("to").alias("root"))
        points = materialise(points.join(further, "to").select("node", "root"), "labels")
        ends_a, ends_b = (points.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        carried = links.join(ends_a, "a").join(ends_b, "b").where("root_a <> root_b")
        carried = materialise(carried.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
        discard(links)
        links = carried
        rounds.append(points)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = rounds.pop()
    while rounds:
        after = whole.select(F.col("node").alias("root"), F.col("root").alias("end"))
        whole = materialise(rounds.pop().join(after, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "labels")
    return materialise(whole.join(whole.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component"), "components")
