"""Spanning trees and clusters over a table of weighted edges, by contraction.

Boruvka rounds: every component takes its lightest edge, components merge along
these, and of the edges between two merged components the lightest stays.  A round
is a few equi-joins and aggregations over the edge table, at least halves the
components and drops the edges inside them, so no task needs the whole graph and no
matrix is built.  Rounds are written to the shared folder; counts alone reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.scratch import written


def merged(links: DataFrame) -> DataFrame:
    """id, root: the smallest id of each tree that the links (id, to; one a row of each id) make.

    Where each id follows its lightest edge, the only cycles are two ids that follow
    the same edge; the smaller of them is the root.  Pointers double, so rounds are
    the logarithm of a tree's depth.
    """
    back = links.select(F.col("id").alias("to"), F.col("to").alias("back"))
    own = (F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))
    tops = written(links.join(back, "to", "left").select("id", F.when(own, F.col("id")).otherwise(F.col("to")).alias("root")), "graph-links")
    while True:
        ahead = tops.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = tops.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        jumped = written(jumped, "graph-jump")
        tops = jumped.select("id", "root")
        if jumped.filter("moved").isEmpty():
            return tops


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, weight) of the lightest spanning forest; equal weights go by (a, b).

    a and b are of one type that compares; edges with a null, of a node with itself
    or given twice don't matter.
    """
    live = edges.select("a", "b", "weight").filter("a <> b AND weight IS NOT NULL")
    ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = written(live.select(F.col("a").alias("from"), F.col("b").alias("to"), F.struct(F.col("weight"), ends.a.alias("a"), ends.b.alias("b")).alias("edge")), "graph-edges")
    chosen = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("to").alias("from"), F.col("from").alias("to"), "edge"))
        best = both.groupBy("from").agg(F.min(F.struct("edge", "to")).alias("x"))  # combined before the shuffle
        best = written(best.select(F.col("from").alias("id"), F.col("x.to").alias("to"), F.col("x.edge").alias("edge")), "graph-best")
        chosen.append(best.select("edge").distinct())
        roots = merged(best.select("id", "to"))
        joined = live.join(roots.select(F.col("id").alias("from"), F.col("root").alias("p")), "from").join(roots.select(F.col("id").alias("to"), F.col("root").alias("q")), "to")
        between = joined.filter("p <> q").groupBy(F.least("p", "q").alias("from"), F.greatest("p", "q").alias("to")).agg(F.min("edge").alias("edge"))
        live = written(between, "graph-edges")
    if not chosen:
        return edges.select("a", "b", "weight").limit(0)
    tree = chosen[0]
    for more in chosen[1:]:
        tree = tree.unionByName(more)
    return tree.select("edge.a", "edge.b", "edge.weight")


def clusters(forest: DataFrame, cutoff: float) -> DataFrame:
    """name, cluster (its smallest name), for the nodes that edges below cutoff tie to another."""
    short = forest.filter(F.col("weight") < cutoff).select("a", "b")
    both = written(short.unionByName(short.select(F.col("b").alias("a"), F.col("a").alias("b"))), "graph-short")
    labels = written(both.select(F.col("a").alias("name")).distinct().withColumn("cluster", F.col("name")), "graph-labels")
    while True:  # the smallest label of the neighbours, then the label of that label
        near = both.join(labels.select(F.col("name").alias("b"), F.col("cluster")), "b").groupBy(F.col("a").alias("name")).agg(F.min("cluster").alias("least"))
        step = labels.join(near, "name").select("name", F.least("cluster", "least").alias("cluster"), (F.col("least") < F.col("cluster")).alias("moved"))
        ahead = labels.select(F.col("name").alias("cluster"), F.col("cluster").alias("next"))
        step = written(step.join(ahead, "cluster", "left").select("name", F.least("cluster", F.coalesce("next", "cluster")).alias("cluster"), "moved"), "graph-step")
        labels = step.select("name", "cluster")
        if step.filter("moved").isEmpty():
            return labels


def correlation_distance(cells: DataFrame) -> DataFrame:
    """a, b, weight = sqrt(2 (1 - rho)), from covariance cells (a, b, cov) of all pairs with a <= b, diagonal included."""
    sd = cells.filter("a = b").select("a", F.sqrt("cov").alias("sd"))
    d = cells.filter("a < b").join(sd.withColumnRenamed("sd", "sa"), "a").join(sd.select(F.col("a").alias("b"), F.col("sd").alias("sb")), "b")
    rho = F.coalesce(F.try_divide(F.col("cov"), F.col("sa") * F.col("sb")), F.lit(0.0))  # a flat series has none
    return d.select("a", "b", F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - rho))).alias("weight"))


def filtered_edges(edges: DataFrame) -> DataFrame:
    """a, b, weight, degree_a, degree_b of the 3 N - 6 shortest edges (one at least) of N nodes; equal weights go by (a, b).

    The report is of the length of its nodes, so a limit finds it, not a sort of all edges in one task.
    """
    nodes = edges.select("a").union(edges.select("b")).distinct().count()
    kept = written(edges.select("a", "b", "weight").orderBy("weight", "a", "b").limit(max(3 * nodes - 6, 1)), "graph-kept")
    degree = kept.select("a").union(kept.select("b")).groupBy("a").agg(F.count(F.lit(1)).cast("int").alias("n"))
    out = kept.join(degree.select("a", F.col("n").alias("degree_a")), "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("degree_b")), "b")
    return out.select("a", "b", "weight", "degree_a", "degree_b")
