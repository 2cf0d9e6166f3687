"""Connected components of links between longs, by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import forget, written


def components(links: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node that can be reached) for every node that has a link to another.

    Each round is written to the shared folder. A node's smallest neighbour comes from an aggregation that combines before the shuffle and is written, too; it then meets the node's links in a join of two tables, whose large keys Spark can split, so a node with a third of all links is no hot spot."""
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    state = _sum(edges)
    for _ in range(most_rounds):
        # large star: a node's larger neighbours go to its smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours and itself go to the smallest one
        large = written(large, "links")
        forget(edges, least)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        forget(large, low)
        now = _sum(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
