"""Connected components of a distributed edge list: union-find by alternating large and small stars.

Edges point from the greater id to the less. A large star ties every greater neighbour of a node to the least id
in its neighbourhood, a small star does so for the less ones; both shrink to stars around the least id of each
component in about log n rounds. Each step is a minimum by node (combined before the shuffle, so a hub may have
any number of neighbours) and a join of the edges with it, which Spark splits where it is skewed. Lineage is cut
by a written table every round, in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # for an edge (v, u) with v > u: v -> the least around u
    return edges.select(F.col("u").alias("v"), F.col("v").alias("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "components") -> DataFrame:
    """(id, component) for every id in an edge; component is the least id that edges reach."""
    now = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), tag)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        now = materialise(_small_star(_large_star(now)), tag)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
