"""Connected components of a table of links, by contraction.

Each round, every node moves to the first of itself and its neighbours, and links between nodes
that moved apart become links between the places they moved to. Links inside one place disappear.
Which is first is drawn anew each round, by a hash of node and round: in the order of the ids, a chain
that runs along them would lose one node a round; drawn, a good third of all nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import Scratch

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids to rows (id, label): ids of one component share their label, one of them."""
    staged = Scratch(links.sparkSession)
    edges = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    for number in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda node: F.struct(F.xxhash64(F.lit(number), node).alias("draw"), F.col(node).alias("node"))
        moves = both.groupBy("a").agg(F.min(drawn("b")).alias("first")).select(
            F.col("a").alias("node"), F.least("first", drawn("a"))["node"].alias("place")
        )
        moves = staged(moves, "moves")
        if labels is None:
            labels = moves.select(F.col("node").alias("id"), F.col("place").alias("label"))
        else:
            moved = labels.join(moves, labels["label"] == moves["node"], "left")
            labels = moved.select("id", F.coalesce("place", "label").alias("label"))
        labels = staged(labels, "labels")
        first = moves.select(F.col("node").alias("a"), F.col("place").alias("pa"))
        second = moves.select(F.col("node").alias("b"), F.col("place").alias("pb"))
        edges = edges.join(first, "a").join(second, "b").where("pa <> pb")
        edges = edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = staged(edges, "links")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return links.sparkSession.createDataFrame([], "id long, label long")
    return staged.result(labels, "component-labels")
