"""Connected components of distributed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph ``edges(a, b)``: one row (node, comp) per
    node with an edge, ``comp`` being the smallest node of its component.

    Each round lets every node point at its smallest neighbour, doubles these pointers until they end
    at a node without a smaller neighbour, and contracts the graph along them, until no edge is left:
    at most half of the nodes stay, so long paths need few rounds. Edges, pointers and labels stay distributed; every
    aggregation has map-side partial results, so that a hub costs one row per task.
    """
    spark = edges.sparkSession
    live = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")), "hop"
        )
        moved = True
        while moved:
            up = hop.select(F.col("node").alias("p"), F.col("p").alias("top"))
            jumped = materialize(hop.join(up, "p").select("node", F.col("top").alias("p"), (F.col("top") != F.col("p")).alias("moved")), "hop")
            moved = not jumped.where("moved").isEmpty()
            hop = jumped.select("node", "p")
        if labels is None:
            labels = hop.select("node", F.col("p").alias("comp"))
        else:
            to = hop.select(F.col("node").alias("comp"), "p")
            # written, or the plan would grow with every round
            labels = materialize(labels.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        left = hop.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        right = hop.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        live = materialize(
            live.join(left, "a")
            .join(right, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
    if labels is None:
        return spark.createDataFrame([], "node long, comp long")
    return labels
