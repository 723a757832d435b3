"""Backtests: event simulations and weight walk-forwards, one task for each run.

A run is sequential (orders depend on equity, equity on fills), so the unit of
parallelism is the run: strategy x parameters x fold.  Bars are joined to the
runs that use them and grouped by run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import estimators as est
from tidewater.operators.strategies import STRATEGIES, Bar, Simulator

EQUITY = "run STRING, seq LONG, ts_nanos LONG, nav DOUBLE, fills LONG, rejected LONG"


def simulate(bars: DataFrame, runs: list[tuple[str, str, dict]], key: str = "fold") -> DataFrame:
    """run, seq, ts_nanos, nav, fills, rejected: one equity point an event.

    runs: (run name, strategy name, parameters).  bars may have a fold column;
    each fold is then a run of its own with a fresh strategy.
    """
    spark = bars.sparkSession
    table = {name: (strategy, settings) for name, strategy, settings in runs}
    for strategy, settings in table.values():
        STRATEGIES[strategy](**settings).validate()
    folds = [key] if key in bars.columns else []
    names = spark.createDataFrame([(n,) for n in table], "run STRING")

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        strategy, settings = table[group[0]]
        frame = frame.sort_values(["ts_nanos", "symbol"], kind="stable")
        sim = Simulator(STRATEGIES[strategy](**settings))
        label = group[0] if not folds else f"{group[0]}#{group[1]}"
        out = []
        for n, r in enumerate(frame.itertuples(index=False)):
            nav = sim.on_bar(Bar(int(r.ts_nanos), r.symbol, r.open, r.high, r.low, r.close, r.volume))
            out.append((label, n, int(r.ts_nanos), nav, sim.fills, sim.rejected))
        return pd.DataFrame(out, columns=["run", "seq", "ts_nanos", "nav", "fills", "rejected"])

    # the runs are named by the caller, so few; every run needs all its bars
    joined = bars.select(*folds, "ts_nanos", "symbol", "open", "high", "low", "close", "volume").join(F.broadcast(names))
    return joined.groupBy("run", *folds).applyInPandas(run, EQUITY)


def folds(bars: DataFrame, n: int) -> DataFrame:
    """bars with fold: n disjoint blocks of time, side by side."""
    times = bars.select("ts_nanos").distinct()
    cut = times.agg(F.percentile("ts_nanos", F.lit([k / n for k in range(1, n)])).alias("cuts"))
    inside = F.aggregate("cuts", F.lit(0), lambda a, e: a + F.when(F.col("ts_nanos") >= e, 1).otherwise(0))
    return bars.join(F.broadcast(cut)).withColumn("fold", inside).drop("cuts")


Weights = Callable[[np.ndarray, list[str]], np.ndarray]


def equal(r: np.ndarray, names: list[str]) -> np.ndarray:
    return np.full(r.shape[1], 1 / r.shape[1])


def zero(r: np.ndarray, names: list[str]) -> np.ndarray:
    return np.zeros(r.shape[1])


def _normal(w: np.ndarray) -> np.ndarray:
    s = np.abs(w).sum()
    return w / s if s > 0 else w


def min_variance(r: np.ndarray, names: list[str]) -> np.ndarray:
    c = np.cov(r, rowvar=False) + 1e-4 * np.eye(r.shape[1])
    w = np.clip(np.linalg.solve(c, np.ones(len(c))), 0, None)
    return w / w.sum() if w.sum() > 0 else equal(r, names)


def _ranked(score: np.ndarray) -> np.ndarray:
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable").astype(float)
    return _normal(rank - rank.mean())


def momentum_xs(r: np.ndarray, names: list[str]) -> np.ndarray:
    return _ranked(r[-60:].sum(0))


def mean_reversion_xs(r: np.ndarray, names: list[str]) -> np.ndarray:
    return -_ranked(r[-5:].sum(0))


def rmt_minvar(r: np.ndarray, names: list[str]) -> np.ndarray:
    if len(r) < 60:
        return equal(r, names)
    sd = np.maximum(r.std(0, ddof=1), 1e-12)
    v, e, _ = est.pca(est.standardise(r))
    c = est.rie(v, e, r.shape[1] / len(r)) * np.outer(sd, sd)
    w = np.linalg.pinv(c) @ np.ones(len(c))
    return _normal(w)


def rmt_residual(r: np.ndarray, names: list[str]) -> np.ndarray:
    """Against the last moves left after the factors above the noise edge."""
    z = est.standardise(r)
    v, e, _ = est.pca(z)
    k = max(1, int((v > (1 + np.sqrt(r.shape[1] / len(r))) ** 2).sum()))
    rest = z - z @ e[:, :k] @ e[:, :k].T
    s = rest[-5:].sum(0)
    return -_normal(s - s.mean())


def cluster_meanrev(r: np.ndarray, names: list[str]) -> np.ndarray:
    """Each name against its cluster's mean, unless the market's last move is extreme."""
    market = r.mean(1)
    sd = market.std(ddof=1)
    if sd > 0 and abs(market[-5:].sum()) / (sd * np.sqrt(5)) > 2:
        return np.zeros(r.shape[1])
    tree = est.spanning_tree(names, np.nan_to_num(np.corrcoef(r, rowvar=False)))
    w = np.zeros(r.shape[1])
    for c in est.clusters(tree, float(np.median([t["weight"] for t in tree])) if tree else 0.0):
        at = [names.index(x) for x in c]
        s = r[-5:, at].sum(0)
        w[at] = -(s - s.mean())
    return _normal(w)


def cointegration_spread(r: np.ndarray, names: list[str], top: int = 10) -> np.ndarray:
    """Against the spreads of the most stationary pairs; ten at most is the strategy's size."""
    p, found = np.cumsum(r, axis=0), []
    for i in range(r.shape[1]):
        for j in range(i + 1, r.shape[1]):
            b, _, _ = est.ols(p[:, j : j + 1], p[:, i])
            e = p[:, i] - b[0] - b[1] * p[:, j]
            t, sd = est.adf(e, 0)["t"], e.std(ddof=1)
            if t < -2.86 and sd > 0:
                found.append((t, i, j, float(b[1]), float(e[-1] / sd)))
    w = np.zeros(r.shape[1])
    for _, i, j, beta, z in sorted(found)[:top]:
        if abs(z) > 1:
            w[i] -= np.sign(z)
            w[j] += np.sign(z) * beta
    return _normal(w)


WEIGHTS: dict[str, Weights] = {f.__name__: f for f in (equal, zero, min_variance, momentum_xs, mean_reversion_xs, rmt_minvar, rmt_residual, cluster_meanrev, cointegration_spread)}


def walk_forward(panel: DataFrame, names: list[str], strategies: list[str], train: int = 252, step: int = 21, cost_bps: float = 4.0, gross_cap: float = 10.0) -> DataFrame:
    """strategy, i, ret, turnover of a wide panel of returns (ts_nanos, names): out-of-sample returns after costs.

    Every rebalance is a group of its own: the rows it trains on and the rows it
    holds are dealt to it, so rebalances of all strategies run side by side.
    Weights that fail or exceed the gross cap are 0.
    """
    rows = panel.withColumn("i", F.row_number().over(Window.orderBy("ts_nanos")).cast("long") - 1)
    last = rows.agg(F.max("i")).first()[0]
    if last is None or last < train:
        return rows.sparkSession.createDataFrame([], "strategy STRING, i LONG, ret DOUBLE, turnover DOUBLE")
    first = F.greatest(F.lit(train).cast("long"), F.lit(train) + F.ceil((F.col("i") - train - step + 1) / step) * step)
    ends = F.sequence(first, F.least(F.col("i") + train, F.lit(train + (last - train) // step * step)), F.lit(step).cast("long"))
    dealt = rows.withColumn("at", F.explode(F.when(first <= F.least(F.col("i") + train, F.lit(train + (last - train) // step * step)), ends)))
    dealt = dealt.join(F.broadcast(panel.sparkSession.createDataFrame([(s,) for s in strategies], "strategy STRING")))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        strategy, at = key
        frame = frame.sort_values("i")
        past, ahead = frame[frame.i < at], frame[frame.i >= at]
        try:
            w = np.asarray(WEIGHTS[strategy](past[names].to_numpy(float)[-train:], list(names)), float)
            if not np.isfinite(w).all() or np.abs(w).sum() > gross_cap:
                w = np.zeros(len(names))
        except Exception:
            w = np.zeros(len(names))
        return pd.DataFrame({"strategy": strategy, "at": at, "i": ahead.i.to_numpy(), "gross_ret": ahead[names].to_numpy(float) @ w, "w": [w.tolist()] * len(ahead)})

    held = dealt.groupBy("strategy", "at").applyInPandas(run, "strategy STRING, at LONG, i LONG, gross_ret DOUBLE, w ARRAY<DOUBLE>")
    o = Window.partitionBy("strategy").orderBy("i")
    before = F.coalesce(F.lag("w").over(o), F.transform("w", lambda x: x * 0))
    moved = F.when(F.col("i") == F.col("at"), F.aggregate(F.zip_with("w", before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))
    return held.select("strategy", "i", (F.col("gross_ret") - moved * cost_bps / 1e4).alias("ret"), (moved / 2).alias("turnover"))


def summary(returns: DataFrame) -> DataFrame:
    """strategy, n, ann_return, ann_vol, sharpe, sortino, max_drawdown, turnover, by Sharpe."""
    o = Window.partitionBy("strategy").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("nav", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(o)))
    d = d.withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(o), F.lit(1.0)) - 1)
    sd, down = F.stddev_samp("ret"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    g = d.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") * 252).alias("ann_return"), (sd * np.sqrt(252)).alias("ann_vol"), F.when(sd > 0, F.avg("ret") / F.when(sd > 0, sd) * float(np.sqrt(252))).otherwise(F.lit(0.0)).alias("sharpe"), F.when(down > 0, F.avg("ret") / F.when(down > 0, down) * float(np.sqrt(252))).otherwise(F.lit(0.0)).alias("sortino"), F.min("dd").alias("max_drawdown"), F.sum("turnover").alias("turnover"))
    return g.orderBy(F.desc("sharpe"), "strategy")


def regime_paths(spark, start: list[float], moves: list[list[float]], means: list[float], sds: list[float], steps: int, paths: int, seed: int = 42, block: int = 10_000) -> DataFrame:
    """path, terminal: Monte-Carlo values; each block of paths has a seed of its own."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame["id"].tolist():
                n = min(block, paths - b * block)
                v = est.monte_carlo(np.array(start), np.array(moves), np.array(means), np.array(sds), steps, n, seed + b)
                yield pd.DataFrame({"path": b * block + np.arange(n), "terminal": v})

    return spark.range(-(-paths // block)).mapInPandas(run, "path LONG, terminal DOUBLE")
