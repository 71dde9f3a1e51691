"""Connected components over an edge table, by alternating large and small stars.

Labels and edges stay distributed; each round is written to the shared folder, and a node of many edges is joined apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_groups, materialise


def _minima(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    least = least.select("u", F.least("u", "m").alias("m"), "degree")
    return join_groups(edges, least, "u", "degree", total)


def _is_forest(edges: DataFrame) -> bool:
    """Whether every edge (u, v) goes from a node of no other edge to a root."""
    return edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) of two orderable columns of one type; root is the component's smallest node."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"] or _is_forest(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        total = 2 * state["n"]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(both, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        small = _minima(large, total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct())
