"""Connected components of links by alternating star contraction, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_split

MOST_ROUNDS = 60


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its smallest node) for every node of the links (columns a, b).

    A large-star round links each node's larger neighbours to its smallest neighbour, a
    small-star round its smaller ones; both keep the components, and rounds end when every
    component is a star. Each round is a partly pre-aggregated minimum and a join, which
    adaptive execution can split at hubs; its links are written to the shared folder. Nodes are longs.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}/0")
    for i in range(MOST_ROUNDS):
        # done when all are stars: no leaf has two centres and no centre is a leaf
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        if ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf = 1 and centre = 1").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = join_split(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now a > b: small stars over each node's smaller neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = join_split(large, least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = scratch.keep(small.distinct(), f"{name}/{i + 1}")
        scratch.drop(f"{name}/{i}")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
