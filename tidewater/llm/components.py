"""Connected components of an edge table, by labels that spread and jump.

Each round, a node takes the smallest label of its neighbours and itself
(pre-aggregated before the shuffle), then the label of its label; so labels
cross a component in about the logarithm of its width.  Every round is written
to the shared folder.  Nodes with more than a thousandth of all edge ends are
met through a broadcast (at most 1000 of them) and their rows stay out of the
shuffle, so a hub doesn't fill one task.  Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, lookup, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable), for every id in edges (a, b); null ends are ignored."""
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    both = materialise(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))), "cc-edges")
    ends = both.count()
    # at first a node's label is its id, so the smallest of its neighbours needs no join
    first = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.min("other").alias("least"))
    labels = materialise(first.select("id", "degree", F.least("id", "least").alias("component")), "cc-labels")
    nodes = labels.count()
    while True:
        told = lookup(both, labels, "id", "degree", ends)
        least = told.groupBy(F.col("other").alias("id")).agg(F.min("component").alias("least"))
        better = labels.join(least, "id").select("id", "degree", F.least("component", "least").alias("component"), (F.col("least") < F.col("component")).alias("moved"))
        better = materialise(better, "cc-step")
        moved = better.filter("moved").count()
        if not moved:
            discard(better, both)
            return labels.select("id", "component")
        # a label is a node: as many nodes may hold it as a component has, so the same care applies
        sizes = better.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
        jumps = materialise(sizes.join(better.select(F.col("id").alias("component"), F.col("component").alias("next")), "component"), "cc-jumps")
        step = lookup(better.select("id", "degree", "component"), jumps, "component", "members", nodes)
        new = materialise(step.select("id", "degree", F.least("component", "next").alias("component")), "cc-labels")
        discard(labels, better, jumps)
        labels = new
