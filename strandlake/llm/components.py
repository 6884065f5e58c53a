"""Connected components of a link table by alternating large-star and small-star steps; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) with u > v. Large star: each node links its larger neighbours to its least one; small star: the others."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        # the reversed side holds exactly the larger neighbours
        return edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = edges.join(least, "u")
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b) to (id, root): the least id that each linked id reaches. Ids without links to others are left out."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = materialize(edges, "links"), None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        state = now
        edges = materialize(_star(_star(edges, large=True), large=False), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
