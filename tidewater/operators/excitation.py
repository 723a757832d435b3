"""Cross-excitation of event streams: a multivariate Hawkes process by expectation-maximisation, over blocks of time.

At one decay the excitation of each event by each stream doesn't depend on what is
fitted.  It is computed once, block by block from the state before each block, and
kept as a table; a round is then one aggregation over that table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.estimators import affine_scan
from tidewater.scratch import written

BLOCK = 100_000  # rows of a block, about
MOST = 20_000  # blocks, whose sums by stream pass the driver


def multivariate_hawkes(df: DataFrame, time: str, kind: str, decay: float = 1.0, rounds: int = 40, rows: int = BLOCK) -> dict:
    """estimators.multivariate_hawkes for streams told by `kind` (few of them), in order of kind: mu, branching, radius, counts."""
    df = df.select(F.col(time).cast("double").alias("t"), F.col(kind).alias("kind"))
    told = sorted(df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).collect())  # a row a stream
    if not told:
        return {"mu": np.zeros(0), "branching": np.zeros((0, 0)), "radius": 0.0, "counts": np.zeros(0, int)}
    k, counts = len(told), np.array([r.n for r in told])
    low, end = min(r.low for r in told), max(r.high for r in told)
    blocks = max(1, min(MOST, -(-int(counts.sum()) // rows)))
    width = max((end - low) / blocks, 1e-9)
    place = F.coalesce(*(F.when(F.col("kind").eqNullSafe(F.lit(r.kind)), i) for i, r in enumerate(told)))
    events = df.select("t", place.alias("c"), F.least(F.floor((F.col("t") - low) / width), F.lit(blocks - 1)).cast("int").alias("block"))

    edge = low + (F.col("block") + 1) * width
    sums = events.groupBy("block", "c").agg(F.sum(F.exp(-decay * (edge - F.col("t")))).alias("s"), F.sum(1 - F.exp(-decay * (end - F.col("t")))).alias("mass")).collect()
    added, mass = np.zeros((blocks, k)), np.zeros(k)
    for r in sums:
        added[r.block, r.c] = r.s
        mass[r.c] += r.mass
    before = np.zeros((blocks, k))  # the state at each block's left edge
    for b in range(1, blocks):
        before[b] = before[b - 1] * math.exp(-decay * width) + added[b - 1]

    def kernel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "c"])
        t, c, start = frame["t"].to_numpy(), frame["c"].to_numpy(), low + key[0] * width
        fade = np.exp(-decay * np.diff(t, prepend=start))
        out = {"c": c}
        for j in range(k):
            came = np.concatenate([[before[key[0], j]], (c[:-1] == j).astype(float)])
            out[f"k{j}"] = decay * affine_scan(fade, fade * came)
        return pd.DataFrame(out)

    names = [f"k{j}" for j in range(k)]
    table = written(events.groupBy("block").applyInPandas(kernel, "c INT, " + ", ".join(f"{n} DOUBLE" for n in names)), "excitation")
    mu, a = np.maximum(counts, 1) / max(end, 1e-9) / 2, np.full((k, k), 0.3 / k)
    for _ in range(rounds):
        rate = F.coalesce(*(F.when(F.col("c") == i, sum((F.col(n) * float(a[i, j]) for j, n in enumerate(names)), F.lit(float(mu[i])))) for i in range(k)))
        got = table.withColumn("w", 1 / rate).groupBy("c").agg(F.sum("w").alias("w"), *(F.sum(F.col(n) * F.col("w")).alias(n) for n in names)).collect()  # a row a stream
        for r in got:
            mu[r.c] *= r.w / max(end, 1e-9)
            a[r.c] *= np.array([r[n] for n in names]) / np.maximum(mass, 1e-9)
    return {"mu": mu, "branching": a, "radius": float(np.abs(np.linalg.eigvals(a)).max()), "counts": counts}
