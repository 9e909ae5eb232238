"""Connected components of a distributed edge list, by alternating hooking and shortcutting.

Nodes are longs. Each round maps every edge's ends to their labels and hooks the larger label onto the
smaller; labels only fall, edges inside one label go, and the edge list shrinks until none is left. Links never leave the cluster; each round is cut by a
checkpoint in the shared folder. Null ends are ignored, repeated edges and loops do no harm, and an empty
edge list gives no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge to another; label is the component's smallest node.

    ``edges`` has the columns a and b. Each round does one hooking (every node takes its smallest neighbour)
    twice) and contracts the graph to the hooks' targets. A star is done after one round. Of a chain whose nodes are in random
    order, as fingerprints are, less than half of the nodes stay each round, so rounds grow with the logarithm of the longest chain.
    """
    live = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up"))
        #: node -> smallest of itself and its neighbours; then one step of pointer jumping
        hop = near.join(near.select(F.col("a").alias("up"), F.col("up").alias("top")), "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        hop = cut(hop)
        levels.append(hop)
        left = live.join(hop.select("a", F.col("up").alias("x")), "a").join(hop.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        live = cut(left.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if not levels:
        return edges.sparkSession.createDataFrame([], "node long, label long")
    labels = levels[-1].select(F.col("a").alias("node"), F.col("up").alias("label"))
    for lower in reversed(levels[:-1]):
        labels = lower.join(labels.select(F.col("node").alias("up"), F.col("label").alias("root")), "up", "left").select(F.col("a").alias("node"), F.coalesce("root", "up").alias("label"))
    return cut(labels)
