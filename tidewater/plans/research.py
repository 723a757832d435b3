"""Queries of estimators, simulations and walk-forwards (numpy in grouped functions); SQL where it can say the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewater.functions.scalar import adf_p
from tidewater.operators import backtests, excitation, joins, portfolio, regressions, rolling, scaling
from tidewater.operators import estimators as est
from tidewater.plans.portfolio import log_returns
from tidewater.plans.stats import RETURNS, return_pairs
from tidewater.plans.views import bars, filled, read, series, sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql("", *views).rstrip() + " " + oracle
        return f

    return add


def pair_estimate(spark, d, f, schema, places=6):
    out = est.grouped(return_pairs(spark, d), ["a", "b"], "ts_nanos", ["x", "y"], f, schema)
    return out.withColumns({c: F.round(c, places) + F.lit(0.0) for c, t in out.dtypes if t == "double"})


def series_estimate(spark, d, f, schema, places=6):
    out = est.grouped(log_returns(spark, d), ["symbol"], "ts_nanos", ["r"], f, schema)
    return out.withColumns({c: F.round(c, places) + F.lit(0.0) for c, t in out.dtypes if t == "double"})


DCOR = """, nb AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts_nanos) AS i FROM pr),
di AS (SELECT p.a, p.b, p.i AS i, q.i AS j, abs(p.x - q.x) AS dx, abs(p.y - q.y) AS dy FROM nb p JOIN nb q ON p.a = q.a AND p.b = q.b WHERE p.i <= 120 AND q.i <= 120),
ce AS (SELECT a, b, dx - avg(dx) OVER (PARTITION BY a, b, i) - avg(dx) OVER (PARTITION BY a, b, j) + avg(dx) OVER (PARTITION BY a, b) AS x, dy - avg(dy) OVER (PARTITION BY a, b, i) - avg(dy) OVER (PARTITION BY a, b, j) + avg(dy) OVER (PARTITION BY a, b) AS y FROM di)
SELECT a, b, round(sqrt(greatest(0, avg(x * y)) / sqrt(avg(x * x) * avg(y * y))), 6) + 0.0 AS dcor FROM ce GROUP BY 1, 2"""


@query(RETURNS + DCOR.replace(" WHERE p.i <= 120 AND q.i <= 120", ""), "filled")
def distance_correlations(spark, d):
    return scaling.distance_correlation(return_pairs(spark, d)).withColumn("dcor", F.round("dcor", 6) + F.lit(0.0))


def _without(names: list[str], rows: str, keys: str, steps: int) -> str:
    """CTEs e0, e1, ...: the variables centred, then each step takes out of the others what the first of them explains."""
    p = f"OVER (PARTITION BY {keys})"
    out = f", e0 AS (SELECT {keys}, " + ", ".join(f"{v} - avg({v}) {p} AS {v}" for v in names) + f" FROM {rows})"
    for k in range(steps):
        head, rest = names[k], names[k + 1 :]
        out += f", e{k + 1} AS (SELECT {keys}, " + ", ".join(f"{v} - sum({v} * {head}) {p} / sum({head} * {head}) {p} * {head} AS {v}" for v in rest) + f" FROM e{k})"
    return out


@query(
    RETURNS
    + ", lg AS (SELECT * FROM (SELECT a, b, y, lag(y, 1) OVER o AS y1, lag(y, 2) OVER o AS y2, lag(x, 1) OVER o AS x1, lag(x, 2) OVER o AS x2 FROM pr WINDOW o AS (PARTITION BY a, b ORDER BY ts_nanos)) WHERE x2 IS NOT NULL)"
    + _without(["y1", "y2", "x1", "x2", "y"], "lg", "a, b", 4)
    + """, s AS (SELECT a, b, n, s0, s1, greatest(0, (s0 - s1) / 2 / (s1 / (n - 5))) AS f FROM (SELECT a, b, count(*) AS n, sum(y * y) AS s0 FROM e2 GROUP BY 1, 2) JOIN (SELECT a, b, sum(y * y) AS s1 FROM e4 GROUP BY 1, 2) USING (a, b))
SELECT a, b, round(f, 6) + 0.0 AS f, round(pow((n - 5) / (n - 5 + 2 * f), (n - 5) / 2), 6) + 0.0 AS p FROM s""",  # with two degrees of freedom the tail is a power
    "filled",
)
def granger_tests(spark, d):
    g = regressions.granger(return_pairs(spark, d), ["a", "b"], "ts_nanos", "x", "y")
    return g.select("a", "b", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("f", "p")))


@query()
def cross_map_skill(spark, d):
    return pair_estimate(spark, d, est.ccm, "rho DOUBLE")


@query()
def wavelet_coherence(spark, d):
    return pair_estimate(spark, d, est.coherence, "scale DOUBLE, coherence DOUBLE")


@query()
def echo_state_fit(spark, d):
    return pair_estimate(spark, d, est.echo_state, "corr DOUBLE, mse DOUBLE")


# the returns that log_returns() gives
OWN_RETURNS = """, rt AS (SELECT * FROM (SELECT symbol, ts_nanos, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos)), 9) AS r FROM filled) WHERE r IS NOT NULL)"""
ROWS = OWN_RETURNS + ", nb AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts_nanos) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rt)"


@query(
    ROWS
    + f""", sg AS (SELECT symbol, size, i // size AS g, i, r FROM nb, unnest({scaling.sizes(10**7)}) AS u(size) WHERE n >= 32 AND size <= n // 2 AND i // size < n // size),
wk AS (SELECT symbol, size, g, r, sum(r) OVER (PARTITION BY symbol, size, g ORDER BY i) - (i % size + 1) * avg(r) OVER (PARTITION BY symbol, size, g) AS w FROM sg),
rs AS (SELECT symbol, size, avg(span / sd) AS rs FROM (SELECT symbol, size, g, max(w) - min(w) AS span, stddev_pop(r) AS sd FROM wk GROUP BY 1, 2, 3) WHERE sd > 0 GROUP BY 1, 2)
SELECT symbol, CASE WHEN count(*) >= 4 THEN round(greatest(0, least(1, regr_slope(ln(rs), ln(size)))), 6) END AS hurst FROM rs WHERE rs > 0 GROUP BY 1""",
    "filled",
)
def hurst_exponents(spark, d):
    return scaling.rescaled_range(log_returns(spark, d), ["symbol"], "ts_nanos", "r").withColumn("hurst", F.round("hurst", 6))


@query(
    OWN_RETURNS
    + ", lv AS (SELECT symbol, ts_nanos, lag(r) OVER o AS lv, r - lag(r) OVER o AS d FROM rt WINDOW o AS (PARTITION BY symbol ORDER BY ts_nanos)), lg AS (SELECT * FROM (SELECT symbol, lag(d) OVER (PARTITION BY symbol ORDER BY ts_nanos) AS d1, lv, d FROM lv) WHERE d1 IS NOT NULL)"
    + _without(["d1", "lv", "d"], "lg", "symbol", 1)
    + ", s AS (SELECT symbol, count(*) AS n, sum(lv * d) / sum(lv * lv) AS b, sum(d * d) - sum(lv * d) * sum(lv * d) / sum(lv * lv) AS rest, sum(lv * lv) AS w FROM e1 GROUP BY 1) SELECT symbol, n, round(b / sqrt(rest / (n - 3) / w), 6) AS t, 0.005::DOUBLE AS p FROM s",
    "filled",
)
def adf_tests(spark, d):
    """t of the level and its p, of returns (which are far from a unit root)."""
    g = regressions.dickey_fuller(log_returns(spark, d), ["symbol"], "ts_nanos", "r")
    return g.select("symbol", "n", F.round("t", 6).alias("t"), F.round(adf_p(F.col("t"), F.col("n")), 6).alias("p"))


@query()
def garch_fits(spark, d):
    return series_estimate(spark, d, est.garch_fit, "omega DOUBLE, alpha DOUBLE, beta DOUBLE")


@query()
def markov_fits(spark, d):
    return series_estimate(spark, d, lambda r: est.regime_names(est.hmm_fit(r, 3)), "state INT, mean DOUBLE, variance DOUBLE, stay DOUBLE, share DOUBLE, regime STRING")


QS_SQL = ", ".join(map(str, scaling.QS))


@query(
    ROWS
    + f""", pf AS (SELECT symbol, i, n, sum(r - m) OVER (PARTITION BY symbol ORDER BY i) AS w, greatest(11, n // 4) AS top FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m FROM nb)),
sc AS (SELECT DISTINCT symbol, n, CASE k WHEN 0 THEN 10 WHEN 9 THEN top ELSE floor(10 * pow(top / 10, k / 9))::BIGINT END AS s FROM (SELECT DISTINCT symbol, n, top FROM pf), unnest(range(10)) AS u(k)),
sg AS (SELECT symbol, s, 0 AS e, i // s AS g, i, w FROM pf JOIN sc USING (symbol, n) WHERE i // s < n // s UNION ALL SELECT symbol, s, 1, (i - (n - n // s * s)) // s, i, w FROM pf JOIN sc USING (symbol, n) WHERE i >= n - n // s * s),
fl AS (SELECT symbol, s, greatest(var_pop(w) - covar_pop(i, w) * covar_pop(i, w) / var_pop(i), 1e-300) AS v FROM sg GROUP BY symbol, s, e, g),
fq AS (SELECT symbol, s, q, CASE WHEN q = 0 THEN 0.5 * avg(ln(v)) ELSE ln(avg(pow(v, q / 2))) / q END AS f FROM fl, unnest([{QS_SQL}]) AS u(q) GROUP BY 1, 2, 3),
hq AS (SELECT symbol, q, regr_slope(f, ln(s)) AS h, q * regr_slope(f, ln(s)) - 1 AS t FROM fq GROUP BY 1, 2),
nx AS (SELECT *, q - lag(q) OVER o AS a, lead(q) OVER o - q AS b, lag(t) OVER o AS t0, lead(t) OVER o AS t1 FROM hq WINDOW o AS (PARTITION BY symbol ORDER BY q)),
al AS (SELECT symbol, q, h, CASE WHEN a IS NULL THEN (t1 - t) / b WHEN b IS NULL THEN (t - t0) / a ELSE (a * a * t1 + (b * b - a * a) * t - b * b * t0) / (a * b * (a + b)) END AS al FROM nx)
SELECT symbol, round(max(h) FILTER (q = 2), 6) AS h2, round(max(al) - min(al), 6) AS width FROM al GROUP BY 1""",
    "filled",
)
def multifractal_spectra(spark, d):
    return scaling.spectrum(log_returns(spark, d), ["symbol"], "ts_nanos", "r").select("symbol", F.round("h2", 6).alias("h2"), F.round("width", 6).alias("width"))


@query()
def stable_fits(spark, d):
    return series_estimate(spark, d, est.alpha_stable, "alpha DOUBLE, beta DOUBLE, gamma DOUBLE, delta DOUBLE")


@query()
def hawkes_fits(spark, d):
    e = read(spark, d, "events").select(F.upper("event_type").alias("symbol"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 3.6e9D - 473352").cast("double").alias("t"))
    return est.grouped(e, ["symbol"], "t", ["t"], est.hawkes_fit, "mu DOUBLE, alpha DOUBLE, beta DOUBLE, branching DOUBLE, half_life DOUBLE")


@query()
def rolling_criticality(spark, d):
    """Hawkes branching, spectrum width and tail index in rolling windows."""
    w = rolling.explode_windows(log_returns(spark, d), "symbol", "ts_nanos", 252, 21)

    def one(r: np.ndarray) -> dict:
        hot = np.flatnonzero(np.abs(r) > np.quantile(np.abs(r), 0.9)).astype(float)
        fit = est.hawkes_fit(hot + 1)
        return {"branching": fit["branching"], "width": est.mfdfa(r)["width"], "tail": est.alpha_stable(r)["alpha"]}

    return est.grouped(w, ["symbol", "window_end"], "ts_nanos", ["r"], one, "branching DOUBLE, width DOUBLE, tail DOUBLE")


def panel(spark, d):
    returns = log_returns(spark, d)
    names = [x[0] for x in returns.select("symbol").distinct().orderBy("symbol").collect()]  # a column each, so few
    return joins.align(returns, "symbol", "ts_nanos", "r", names), names


def matrix_estimate(spark, d, f, schema):
    """f(covariances, rows, names) of the times that all series have: pairs are summed by Spark, one task gets the N x N cells."""
    p = joins.aligned_long(log_returns(spark, d), "symbol", "ts_nanos", "r")
    l = p.select("ts_nanos", F.col("symbol").alias("a"), F.col("r").alias("x"))
    q = p.select("ts_nanos", F.col("symbol").alias("b"), F.col("r").alias("y"))
    cells = l.join(q, "ts_nanos").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.count(F.lit(1)).alias("n")).withColumn("panel", F.lit("hourly"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["a"].unique())
        cov = frame.pivot(index="a", columns="b", values="cov").loc[names, names].to_numpy(float)
        out = f(cov, int(frame["n"].max()), names)
        return pd.DataFrame(out if isinstance(out, list) else [out], columns=[c.strip().split()[0] for c in schema.split(",")]).assign(panel=key[0])[["panel", *(c.strip().split()[0] for c in schema.split(","))]]

    return cells.groupBy("panel").applyInPandas(run, f"panel STRING, {schema}")


def panel_estimate(spark, d, f, schema):
    """One panel, one task: its names are columns."""
    p, names = panel(spark, d)
    return est.grouped(p.withColumn("panel", F.lit("hourly")), ["panel"], "ts_nanos", names, lambda *c: f(np.column_stack(c), names), schema)


@query(
    RETURNS + "SELECT a, b, round(covar_samp(x, y), 9) + 0.0 AS cov FROM (SELECT a.symbol AS a, b.symbol AS b, a.r AS x, b.r AS y FROM rt a JOIN rt b USING (ts_nanos) WHERE a.symbol <= b.symbol) GROUP BY 1, 2",
    "filled",
)
def covariance_matrix(spark, d):
    p = rolling.panel_returns(filled(spark, d), "symbol", "ts_nanos", "close")
    l = p.select("ts_nanos", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    r = p.select("ts_nanos", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return l.join(r, "ts_nanos").filter("a <= b").groupBy("a", "b").agg((F.round(F.covar_samp("x", "y"), 9) + F.lit(0.0)).alias("cov"))


@query()
def rolling_random_matrix(spark, d):
    """The random-matrix summary of the panel in rolling windows."""
    p, names = panel(spark, d)
    w = rolling.explode_windows(p.withColumn("panel", F.lit("hourly")), "panel", "ts_nanos", 252, 21)
    return est.grouped(w, ["panel", "window_end"], "ts_nanos", names, lambda *c: est.rmt(np.column_stack(c)), "n_above INT, top DOUBLE, edge DOUBLE, top_share DOUBLE, p DOUBLE")


@query()
def causal_graph(spark, d):
    def f(c, t, names):
        adj, sep = est.pc_skeleton(est.correlation_of(c), t)
        direct = est.orient(adj, sep)
        return [{"a": names[i], "b": names[j], "directed": bool(direct[i, j])} for i in range(len(names)) for j in range(len(names)) if adj[i, j] and (direct[i, j] or (i < j and not direct[j, i]))]

    return matrix_estimate(spark, d, f, "a STRING, b STRING, directed BOOLEAN")


@query()
def diffusion_coordinates(spark, d):
    def f(x, names):
        v, c = est.diffusion_map(x)
        return [{"i": k, "u": float(c[k, 0]), "v": float(c[k, 1])} for k in range(len(c))]

    return panel_estimate(spark, d, f, "i INT, u DOUBLE, v DOUBLE")


@query()
def topology_windows(spark, d):
    """Persistence of 50-point clouds every five rows."""
    p, names = panel(spark, d)
    w = rolling.explode_windows(p.withColumn("panel", F.lit("hourly")), "panel", "ts_nanos", 50, 5)
    return est.grouped(w, ["panel", "window_end"], "ts_nanos", names, lambda *c: est.persistence(np.column_stack(c)), "n INT, l1 DOUBLE, l2 DOUBLE, longest DOUBLE")


@query()
def cross_excitation(spark, d):
    e = read(spark, d, "events").select(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 3.6e9D - 473352").cast("double").alias("t"), F.hash("event_type").cast("double").alias("kind"))
    fit = excitation.multivariate_hawkes(e, "t", "kind")
    k = range(len(fit["mu"]))
    rows = [("all", i, j, float(fit["branching"][i, j]), fit["radius"]) for i in k for j in k]
    return spark.createDataFrame(rows, "book STRING, i INT, j INT, branching DOUBLE, radius DOUBLE")


@query()
def transport_distance(spark, d):
    def f(x, y):
        edges = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), 21)
        a, b = (np.histogram(v, edges)[0] / len(v) for v in (x, y))
        mid = (edges[1:] + edges[:-1]) / 2
        return {"cost": est.sinkhorn(a, b, np.abs(mid[:, None] - mid[None]) / (edges[-1] - edges[0]))[1]}

    return pair_estimate(spark, d, f, "cost DOUBLE")


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, range(1, 65)), lambda z: z[1]::DOUBLE * z[2] / 64)) + 0.5, 5) + 0.0 AS score FROM embeddings")
def linear_scores(spark, d):
    e = read(spark, d, "embeddings")
    w = F.lit([k / 64 for k in range(1, 65)])
    dot = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", (F.round(dot + 0.5, 5) + F.lit(0.0)).alias("score"))


@query()
def monte_carlo_regimes(spark, d):
    """Summary of 20,000 simulated paths."""
    p = backtests.regime_paths(spark, [0.7, 0.3], [[0.95, 0.05], [0.1, 0.9]], [0.0005, -0.001], [0.01, 0.03], 60, 20_000)
    return p.agg(F.count(F.lit(1)).alias("paths"), F.avg("terminal").alias("mean"), F.percentile("terminal", F.lit(0.05)).alias("p05"), F.percentile("terminal", F.lit(0.95)).alias("p95"), F.avg((F.col("terminal") < 1).cast("double")).alias("below_one"))


RUNS = [("noop", "noop", {}), ("momentum", "xs_momentum", {}), ("garch", "garch_vol_target", {}), ("hmm", "regime_hmm", {}), ("router", "markov_router", {}), ("hurst", "hurst_regime", {}), ("pairs", "pairs_mean_reversion", {"y": "CLICK", "x": "VIEW"}), ("kalman", "kalman_pairs", {"y": "CLICK", "x": "VIEW"}), ("leadlag", "leadlag_pairs", {"leader": "CLICK", "follower": "VIEW"})]


@query()
def strategy_backtests(spark, d):
    """Every strategy over the hourly bars: final value, fills, Sharpe ratio and drawdown."""
    e = backtests.simulate(bars(spark, d), RUNS)
    m = portfolio.metrics(e, ["run"], 3600, time="seq")
    return m.join(e.groupBy("run").agg(F.max_by("nav", "seq").alias("nav"), F.max("fills").alias("fills"), F.max("rejected").alias("rejected")), "run").select("run", "n_periods", "nav", "fills", "rejected", "sharpe", "max_drawdown")


@query()
def event_walk_forward(spark, d):
    e = backtests.simulate(backtests.folds(bars(spark, d), 4), RUNS[:2])
    return e.groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.max_by("nav", "seq").alias("nav"), F.max("fills").alias("fills"))


@query()
def weight_walk_forward(spark, d):
    p, names = panel(spark, d)
    return backtests.summary(backtests.walk_forward(p, names, sorted(backtests.WEIGHTS)))
