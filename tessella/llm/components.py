"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that an edge has. Loops and repeats are allowed.

    Each round is written to the shared folder. Minima are taken before each shuffle and stand in a table before rows are
    joined to them: with a table on either side of the join, the adaptive planner can split the rows of a node of very
    many edges. No edges give no nodes.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
        now = first = scratch.table(now, "edges")
        last = None
        while True:
            # Large star: each larger neighbour of a node is tied to the node's smallest neighbour.
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "lowest")
            large = scratch.table(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
            # Small star: each smaller neighbour, and the node, is tied to the smallest.
            least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            after = scratch.table(small, "small")
            scratch.drop(low, large, least, *([] if now is first else [now]))
            now = after
            said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if said == last:
                break
            last = said
        nodes = first.select(F.col("u").alias("node")).union(first.select(F.col("v").alias("node"))).distinct()
        found = nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
        return scratch.keep(found.select("node", F.coalesce("component", "node").alias("component")), "components")
