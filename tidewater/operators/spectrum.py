"""Leading eigenpairs of a symmetric matrix that is a table of cells, by block power iteration.

Each step multiplies a block of vectors (a row a name, a column a vector) by the
matrix in one join and aggregation over the cells; the block's inner products, a
few hundred numbers whatever the size of the matrix, are one more, and from these
the driver takes the Ritz values, the residuals and the next basis.  The block has
some vectors more than are wanted, so convergence depends on the gap behind it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.scratch import written

OVERSAMPLE = 8


def _combined(columns: list[str], by: np.ndarray) -> list[Column]:
    """Columns v0, v1, ...: the linear combinations of columns that by's columns give."""
    return [sum((F.col(c) * float(by[i, j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"v{j}") for j in range(by.shape[1])]


def _products(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """left^T right, summed over the rows."""
    sums = df.agg(*(F.sum(F.col(a) * F.col(b)) for a in left for b in right)).first()  # one row
    return np.array([x or 0.0 for x in sums], float).reshape(len(left), len(right))


def _residual(df: DataFrame, block: list[str], images: list[str], vectors: np.ndarray, values: np.ndarray) -> float:
    """The largest norm of image - value * vector over the Ritz pairs."""
    apart = [sum((float(vectors[i, k]) * (F.col(w) - float(values[k]) * F.col(v)) for i, (v, w) in enumerate(zip(block, images, strict=True))), F.lit(0.0)) for k in range(len(values))]
    return float(np.sqrt(max(x or 0.0 for x in df.agg(*(F.sum(c * c) for c in apart)).first())))  # one row


def _basis(gram: np.ndarray) -> np.ndarray:
    """What makes vectors with these inner products orthonormal; directions that vanish are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(values.max(), 0) * 1e-14
    return vectors[:, keep] / np.sqrt(values[keep])


def top_eigenpairs(cells: DataFrame, count: int, tolerance: float = 1e-10, most: int = 500, oversample: int = OVERSAMPLE) -> DataFrame:
    """k (0 for the largest), name, eigenvalue, share (of the trace), loading; a vector's largest loading is positive.

    cells: a, b, x, each pair of names in both orders, the diagonal included; positive
    semidefinite.  Steps end when all residuals are below tolerance times the largest
    eigenvalue, or after `most` of them.
    """
    names = cells.select(F.col("a").alias("name")).distinct()
    n, trace = names.count(), cells.filter("a = b").agg(F.sum("x")).first()[0] or 0.0
    block = [f"v{j}" for j in range(min(n, count + oversample))]
    if not block:
        return cells.sparkSession.createDataFrame([], "k int, name string, eigenvalue double, share double, loading double")
    start = written(names.select("name", *((F.xxhash64("name", F.lit(j)) / F.lit(2.0**63)).alias(c) for j, c in enumerate(block))), "eigen-block")
    turn = _basis(_products(start, block, block))
    held = written(start.select("name", *_combined(block, turn)), "eigen-block")
    for _ in range(most):
        block = [c for c in held.columns if c != "name"]
        image = cells.join(held.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(*(F.sum(F.col("x") * F.col(c)).alias(f"w{c}") for c in block))
        both = written(held.join(image, "name"), "eigen-step")
        images = [f"w{c}" for c in block]
        h, g = _products(both, block, images), _products(both, images, images)
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)[:count]
        values, vectors = values[order], vectors[:, order]
        wide = np.einsum("ik,ij,jk->k", vectors, g, vectors) - 2 * values * np.einsum("ik,ij,jk->k", vectors, (h + h.T) / 2, vectors) + values**2
        size = max(abs(values[0]), 1e-300)
        # the products tell residuals down to the root of the rounding; from there on they are summed themselves
        if np.sqrt(np.maximum(wide, 0)).max() <= 1e-6 * size and _residual(both, block, images, vectors, values) <= tolerance * size + 1e-15:
            break
        held = written(both.select("name", *_combined(images, _basis(g))), "eigen-block")
    found = both.select("name", *_combined(block, vectors))
    tops = [c for c in found.columns if c != "name"]
    largest = found.agg(*(F.max_by(c, F.struct(F.round(F.abs(c), 12), "name")) for c in tops)).first()  # one row
    rows = [F.struct(F.lit(k).alias("k"), F.lit(float(values[k])).alias("eigenvalue"), F.lit(float(values[k] / trace) if trace else 0.0).alias("share"), (F.col(c) * (-1.0 if largest[k] < 0 else 1.0)).alias("loading")) for k, c in enumerate(tops)]
    return found.select("name", F.explode(F.array(*rows)).alias("z")).select("z.k", "name", "z.eigenvalue", "z.share", "z.loading")
