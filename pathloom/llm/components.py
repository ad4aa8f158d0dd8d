"""Connected components of a graph given as edges.

Every node takes the least label among its neighbours and then the label of
its label (pointer jumping), so that the number of rounds grows with the
logarithm of the longest chain.  Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (the least node of it) for every node of an edge.

    Edges with a null side say nothing; a self link makes a node without a link.
    """
    pairs = edges.select(F.col(a).alias("_x"), F.col(b).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    both = written(pairs.union(pairs.select("_y", "_x")).distinct(), "links")
    nodes = both.groupBy(F.col("_x").alias("node")).agg(F.least(F.min("_x"), F.min("_y")).alias("component"))
    nodes = written(nodes, "components")
    while True:
        near = both.join(nodes, both["_y"] == nodes["node"]).groupBy("_x").agg(F.min("component").alias("_near"))
        grown = nodes.join(near, nodes["node"] == near["_x"]).select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_old"))
        above = grown.select(F.col("node").alias("_n"), F.col("component").alias("_up"))
        grown = grown.join(above, grown["component"] == above["_n"], "left").select("node", F.least("component", F.coalesce("_up", "component")).alias("component"), "_old")
        grown = written(grown, "components")
        changed = grown.filter(F.col("component") != F.col("_old")).limit(1).count()
        nodes = grown.select("node", "component")
        if not changed:
            return nodes
