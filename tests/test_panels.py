"""Spanning trees, clusters and eigenpairs over tables of pairs against one-matrix computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import estimators, graphs
from tidewater.operators.spectrum import top_eigenpairs


def panel(n=24, t=200, seed=3):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(t, 3)) @ rng.normal(size=(3, n)) + 0.7 * rng.normal(size=(t, n)), 6)


def names_of(n):
    return [f"n{k:02d}" for k in range(n)]


def cells_of(spark, m):
    names = names_of(len(m))
    return spark.createDataFrame([(names[i], names[j], float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "a string, b string, x double")


def test_tree_is_kruskals(spark):
    corr = np.corrcoef(panel(), rowvar=False)
    want = {(e["a"], e["b"]): e["weight"] for e in estimators.spanning_tree(names_of(24), corr)}
    edges = cells_of(spark, np.sqrt(np.maximum(0, 2 * (1 - corr)))).filter("a < b").withColumnRenamed("x", "weight")
    got = {(r.a, r.b): r.weight for r in graphs.spanning_forest(edges).collect()}
    assert got == pytest.approx(want)
    cutoff = sorted(want.values())[12]
    sets = estimators.clusters([{"a": a, "b": b, "weight": w} for (a, b), w in want.items()], cutoff)
    told = {}
    for r in graphs.clusters(graphs.spanning_forest(edges), cutoff).collect():
        told.setdefault(r.cluster, set()).add(r.name)
    assert sorted(map(sorted, told.values())) == sorted(map(sorted, sets)) and all(k == min(v) for k, v in told.items())


def test_forest_of_ties_gaps_and_odd_edges(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0), (4, 1, 1.0), (10, 11, 2.0), (11, 10, 3.0), (10, 10, 0.1), (20, 21, None), (None, 1, 0.5)]
    got = {(r.a, r.b, r.weight) for r in graphs.spanning_forest(spark.createDataFrame(rows, "a long, b long, weight double")).collect()}
    assert got == {(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (10, 11, 2.0)}  # equal weights by (a, b)
    assert graphs.spanning_forest(spark.createDataFrame([], "a long, b long, weight double")).count() == 0
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (100.0 - F.col("id")).alias("weight"))  # one long chain
    assert graphs.spanning_forest(path).count() == 40
    assert {r.cluster for r in graphs.clusters(graphs.spanning_forest(path), 1000.0).collect()} == {0}


@pytest.mark.parametrize("oversample", [0, 8])
def test_eigenpairs_of_one_matrix(spark, oversample):
    cov = np.cov(panel(20), rowvar=False)
    values, vectors = np.linalg.eigh(cov)
    got = {(r.k, r.name): r for r in top_eigenpairs(cells_of(spark, cov), 2, 1e-9, oversample=oversample).collect()}
    assert len(got) == 40
    for k in range(2):
        v = vectors[:, -1 - k] * np.sign(vectors[np.abs(vectors[:, -1 - k]).argmax(), -1 - k])
        assert [got[k, n].loading for n in names_of(20)] == pytest.approx(v.tolist(), abs=1e-6)
        assert got[k, "n00"].eigenvalue == pytest.approx(values[-1 - k], rel=1e-9) and got[k, "n00"].share == pytest.approx(values[-1 - k] / np.trace(cov))


def test_eigenpairs_of_flat_and_no_cells(spark):
    assert top_eigenpairs(cells_of(spark, np.zeros((0, 0))), 2).count() == 0
    assert [r.eigenvalue for r in top_eigenpairs(cells_of(spark, np.outer([1.0, 2.0], [1.0, 2.0])), 1).collect()] == pytest.approx([5.0, 5.0])
