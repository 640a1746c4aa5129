"""Connected components of a table of links, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.tables import stage



def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link with one node that stands for its component, the same for all of them.

    Each round maps every node to its smallest neighbour, itself included, and
    moves the links along; links that become loops go. Stars are done in one round. The
    smallest neighbour is found by partial aggregation, so a hub is no hot spot, and every round
    is written to the shared folder. The maps are chained at the end. Null nodes and links of a node
    with itself say nothing.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    maps: list[DataFrame] = []
    while True:
        low_high = ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        both = low_high.select("x", "y").union(low_high.select("y", "x"))
        near = stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("component")))
        maps.append(near)
        moved = low_high.join(near.toDF("x", "to_x"), "x").join(near.toDF("y", "to_y"), "y").where("to_x <> to_y")
        moved = moved.select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).distinct()
        ends = stage(moved)
        if ends.isEmpty():
            break
    labels = maps[0]
    for step in maps[1:]:
        labels = labels.join(step.toDF("component", "next"), "component", "left")
        labels = labels.select("node", F.coalesce("next", "component").alias("component"))
    return labels
