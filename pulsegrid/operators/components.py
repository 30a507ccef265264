"""Connected components by repeated contraction, without any driver-side graph state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every endpoint of ``edges(a, b)`` with the smallest id it can reach.

    Each round points every node at its smallest neighbour, follows one more
    hop, and rewrites the remaining edges between the targets.  A target is
    never larger than its node and always in the same component, so the
    smallest node survives every contraction; rounds stay near-logarithmic
    because whole neighbourhoods collapse at once.  Self-loops keep isolated
    nodes.  Null endpoints are ignored.

    Returns ``(node, component)``, one row per distinct endpoint.
    """
    edges = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut_lineage(nodes.withColumn("component", F.col("node")))
    live = cut_lineage(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    for _ in range(max_rounds):
        if live.isEmpty():
            return labels
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        far = hop.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        target = cut_lineage(
            hop.join(far, "p", "left").select("a", F.coalesce("pp", "p").alias("t"))
        )
        left = target.select("a", F.col("t").alias("ta"))
        right = target.select(F.col("a").alias("b"), F.col("t").alias("tb"))
        live = cut_lineage(
            live.join(left, "a").join(right, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        moved = target.select(F.col("a").alias("component"), "t")
        labels = cut_lineage(
            labels.join(moved, "component", "left").select("node", F.coalesce("t", "component").alias("component"))
        )
    raise RuntimeError("components did not settle")


def connected_stars(edges: DataFrame) -> DataFrame:
    """As :func:`connected_components`, for edges that mostly are stars around their least node.

    Every node goes with its least neighbour, if that is less.  What else there
    is to join are the lesser neighbours of one node, so the rounds are over
    these alone, and not over all nodes.  ``edges`` is read once.
    """
    found = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    mine = Window.partitionBy("a").orderBy("b")
    marked = cut_lineage(found.select("a", "b", F.first("b").over(mine).alias("m"), F.row_number().over(mine).alias("n")), drop_shuffles=True)
    tree, low = marked.where("n = 1").select("a", "m"), cut_lineage(marked.select("b").distinct(), drop_shuffles=True)
    inner = low.join(tree.withColumnRenamed("a", "b"), "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
    links = marked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(inner).distinct()
    ends = connected_components(cut_lineage(links, drop_shuffles=True)).select(F.col("node").alias("m"), "component")
    outer = tree.join(low.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), "m")
    nodes = outer.unionByName(low.select(F.col("b").alias("node"), F.col("b").alias("m")))
    return nodes.join(ends, "m", "left").select("node", F.coalesce("component", "m").alias("component"))
