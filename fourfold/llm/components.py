"""Connected components of a link table, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per linked node: node, component (the smallest node reachable).

    `links` has two long columns; nulls and loops are left out, and repeats or both directions may occur. Every round
    ties each node's larger neighbours, then its smaller ones, to the smallest node that it sees. Nothing but two sums
    reaches the driver; each round is checkpointed, so lineage stays short and lost executors cost no earlier round. A
    node with very many links is read by one row per map task, as the minimum is summed up before it moves, and its links
    meet that one minimum in a join whose large partitions Spark splits.
    """
    a, b = F.col(a), F.col(b)
    edges = checkpointed(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("low"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = checkpointed(small.union(low.select("u", F.col("low").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    top = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)
