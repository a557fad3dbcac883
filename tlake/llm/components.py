"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """v, part: for every vertex of the edges (a, b), the least vertex of its component.

    Each round takes the least label of all neighbours and then the label of that label, so long paths shrink fast. Labels
    are written to the checkpoint folder after each round; no link reaches the driver, only the number of changes.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("part")).checkpoint()
    while True:
        near = (
            both.join(labels.select(F.col("v").alias("b"), F.col("part").alias("near")), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("near").alias("near"))
        )
        step = labels.join(near, "v").select("v", F.least("part", "near").alias("to"), F.col("part").alias("old"))
        jump = labels.select(F.col("v").alias("to"), F.col("part").alias("far"))
        # Every label is a vertex of its own component, so the join finds it.
        after = step.join(jump, "to").select("v", F.least("to", "far").alias("part"), "old").checkpoint()
        labels = after.select("v", "part")
        if not after.filter(F.col("part") < F.col("old")).take(1):
            return labels
