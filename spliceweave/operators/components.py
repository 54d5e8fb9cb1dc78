"""Connected components by alternating large-star and small-star contraction.

Each half round is one minimum per node (combined map-side) and one equi join, so a hub node
costs a skewed join key at worst, which adaptive execution splits. Rounds grow with the
logarithm of the component size; the loop ends when nothing is left to contract.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.session import cut_lineage, drop_stage


def connected_components(edges: DataFrame, src: str, dst: str, within: Sequence[str] = ()) -> DataFrame:
    """(within..., node, component) for every node of ``edges``; component = smallest node.

    ``src`` and ``dst`` are integers that name nodes inside one ``within`` group.
    """
    g = list(within)
    start = cut_lineage(edges.select(*g, F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct())
    nodes = start.select(*g, F.explode(F.array("hi", "lo")).alias("node")).distinct()
    links = start.filter("hi > lo")
    while True:
        # large star: point every larger neighbour of a node at the node's smallest neighbour
        parent = links.groupBy(*g, F.col("hi").alias("lo")).agg(F.min("lo").alias("top"))
        starred = links.join(parent, [*g, "lo"], "left").select(
            *g, "hi", F.coalesce("top", "lo").alias("lo")
        )
        # small star: point a node and its smaller neighbours at the smallest of them
        parent = starred.groupBy(*g, "hi").agg(F.min("lo").alias("top"))
        paired = starred.join(parent, [*g, "hi"])
        moved = paired.filter(F.col("lo") > F.col("top")).select(*g, F.col("lo").alias("hi"), F.col("top").alias("lo"))
        before, links = links, cut_lineage(moved.unionByName(parent.select(*g, "hi", F.col("top").alias("lo"))).distinct())
        drop_stage(before)
        roles = links.select(
            *g, F.inline(F.array(
                F.struct(F.col("hi").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")),
                F.struct(F.col("lo").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")),
            ))
        )
        unsettled = (
            roles.groupBy(*g, "node")
            .agg(F.sum("child").alias("child"), F.max("root").alias("root"))
            .filter("child > 1 OR (child = 1 AND root = 1)")
        )
        if unsettled.isEmpty():
            break
    roots = links.select(*g, F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.join(roots, [*g, "node"], "left").select(
        *g, "node", F.coalesce("component", "node").alias("component")
    )
