"""Connected components of a graph that is held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, component) for the nodes of links (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: links are re-hung on the smallest neighbour until they
    form stars. Each round is a minimum per node (combined before the shuffle) and a join whose large
    partitions Spark may split, and is written to a table, so lineage stays short. Nulls, loops and
    repeated links are dropped; an empty table gives no rows.
    """
    both = links.filter("a is not null and b is not null and a <> b")
    edges = scratch.table(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    last, round_ = None, 0
    while True:
        # large star: neighbours larger than a node go to the least of node and neighbours
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        round_ += 1
        new = scratch.table(low.select("u", F.col("m").alias("v")).union(moved).filter("u <> v").distinct(), f"{name}-{round_}")
        scratch.drop(f"{name}-{round_ - 1}")
        edges = new
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    # a fixed point is a set of stars
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
