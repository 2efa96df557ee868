"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v). The minimum of each neighbourhood comes from a map-side aggregate, then a join.

    The minima are written first, so the join's hot keys (a centre with a third of all nodes) are plain rows that Spark splits.
    """
    if large:
        links = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = materialize(least)
    joined = links.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of (u, v) edges; root is the smallest node of its component.

    Nodes are longs. Self-loops, repeated edges and both directions of an edge are allowed; rows with a null end
    are ignored. No edges give no rows. Each round ends in the shared folder, so the plan stays short.
    """
    edges = edges.select("u", "v").filter("u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        edges = materialize(_star(_star(edges, True), False))
        # Stars stay as they are; sums of hashes tell equal edge sets.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = now
    raise RuntimeError("components did not settle")
