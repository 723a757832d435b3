"""Signal-translation queries and the research report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import dependence as dep
from tidewater.operators import estimators as est
from tidewater.operators import packs
from tidewater.operators import translation as tr
from tidewater.plans.portfolio import log_returns
from tidewater.plans.research import matrix_estimate, pair_estimate, panel, panel_estimate
from tidewater.plans.stats import RANKED, RETURNS, return_pairs
from tidewater.plans.views import read, sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql("", *views).rstrip() + " " + oracle if views else oracle
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


@query(
    RETURNS
    + """, qb AS (SELECT a, b, ts_nanos, least(2, ((row_number() OVER (PARTITION BY a, b ORDER BY x, ts_nanos) - 1) * 3) // count(*) OVER (PARTITION BY a, b)) AS x, least(2, ((row_number() OVER (PARTITION BY a, b ORDER BY y, ts_nanos) - 1) * 3) // count(*) OVER (PARTITION BY a, b)) AS y FROM pr),
hs AS (SELECT a, b, 1 AS h, x, y, lead(y, 1) OVER o AS nx FROM qb WINDOW o AS (PARTITION BY a, b ORDER BY ts_nanos) UNION ALL SELECT a, b, 5, x, y, lead(y, 5) OVER o FROM qb WINDOW o AS (PARTITION BY a, b ORDER BY ts_nanos) UNION ALL SELECT a, b, 21, x, y, lead(y, 21) OVER o FROM qb WINDOW o AS (PARTITION BY a, b ORDER BY ts_nanos)),
fl AS (SELECT a, b, h, nx, y, x, count(*) AS c FROM hs WHERE nx IS NOT NULL GROUP BY ALL)
SELECT a, b, h, round(greatest(0, sum(c / n * ln(c * cy / (cyx * cny)))), 6) + 0.0 AS te FROM (SELECT *, sum(c) OVER (PARTITION BY a, b, h, y, x) AS cyx, sum(c) OVER (PARTITION BY a, b, h, nx, y) AS cny, sum(c) OVER (PARTITION BY a, b, h, y) AS cy, sum(c) OVER (PARTITION BY a, b, h) AS n FROM fl) GROUP BY 1, 2, 3""",
    "filled",
)
def horizon_transfer_entropy(spark, d):
    return tr.horizon_entropy(return_pairs(spark, d)).withColumn("te", r("te"))


@query(
    RETURNS
    + """, ld AS (SELECT a, b, x, lead(y, 1) OVER o AS y1, lead(y, 5) OVER o AS y5, lead(y, 21) OVER o AS y21 FROM pr WINDOW o AS (PARTITION BY a, b ORDER BY ts_nanos)),
tl AS (SELECT a, b, h, x, CASE h WHEN 1 THEN y1 WHEN 5 THEN y5 ELSE y21 END AS y FROM ld, unnest([1, 5, 21]) AS u(h)),
g AS (SELECT a, b, h, count(*) AS n, count(*) FILTER (sign(x) = sign(y)) AS s FROM tl WHERE x <> 0 AND y <> 0 GROUP BY 1, 2, 3),
z AS (SELECT a, b, h, CASE WHEN n >= 30 THEN s / n ELSE 0.5::DOUBLE END AS hit, CASE WHEN n >= 30 THEN abs((s / n - 0.5) / sqrt(0.25 / n)) / sqrt(2) ELSE 0 END AS v FROM g),
p AS (SELECT *, CASE WHEN v < 2.5 THEN 1 - 2 / sqrt(pi()) * exp(-v * v) * list_sum(list_transform(range(61), lambda k: v * pow(2 * v * v, k) / coalesce(list_product(list_transform(range(1, k + 1), lambda j: 2.0::DOUBLE * j + 1)), 1)))
  ELSE exp(-v * v) / sqrt(pi()) / list_reduce(list_prepend(v, list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda s, k: v + k / 2 / s) END AS p FROM z),
f AS (SELECT *, hit - 0.05 * log10(greatest(p, 1e-300)) AS score, coalesce(hit <= lag(hit) OVER (PARTITION BY a, b ORDER BY h), true) AS falls FROM p)
SELECT a, b, arg_max(h, (score, -h)) AS best_h, round(max(score), 6) + 0.0 AS score, bool_and(falls) AS decays FROM f GROUP BY 1, 2""",
    "filled",
)
def horizon_edge_screen(spark, d):
    return tr.edge_screen(return_pairs(spark, d)).withColumn("score", r("score"))


@query()
def cross_map_convergence(spark, d):
    return pair_estimate(spark, d, tr.cross_map_convergence, "dim INT, rho DOUBLE, convergence DOUBLE")


@query()
def covariance_lift(spark, d):
    return matrix_estimate(spark, d, lambda c, t, names: tr.rie_lift(c, t), "sample_vol DOUBLE, rie_vol DOUBLE, lift DOUBLE, fires BOOLEAN")


@query()
def tail_risk_gap(spark, d):
    w = log_returns(spark, d).withColumn("name", F.col("symbol"))
    out = [est.grouped(w.filter(F.col("symbol") == s), ["symbol"], "ts_nanos", ["r"], lambda x, s=s: tr.var_gap(x, s), "gaussian DOUBLE, stable DOUBLE, under DOUBLE") for s in panel(spark, d)[1]]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query(
    RETURNS + RANKED + """, td AS (SELECT a, b, round(count(*) FILTER (x / (n + 1) > 0.9 AND y / (n + 1) > 0.9) / (count(*) * (1 - 0.9::DOUBLE)), 6) + 0.0 AS upper, round(count(*) FILTER (x / (n + 1) <= 1 - 0.9::DOUBLE AND y / (n + 1) <= 1 - 0.9::DOUBLE) / (count(*) * (1 - 0.9::DOUBLE)), 6) + 0.0 AS lower FROM rk GROUP BY 1, 2)
SELECT a, b, upper, lower FROM td WHERE upper >= 0.1 OR lower >= 0.1""",
    "filled",
)
def panic_pairs(spark, d):
    tails = dep.tail_dependence(return_pairs(spark, d)).withColumns({"upper": r("upper"), "lower": r("lower")})
    return tr.panic_pairs(tails, 0.1).select("a", "b", "upper", "lower")


@query()
def symbolic_signal(spark, d):
    """The best expression of the other symbols' returns for the next return of one."""
    def f(x, names):
        data = {n: x[:-1, k] for k, n in enumerate(names)}
        tree, score = tr.symbolic_regression(data, x[1:, 0])
        return {"expression": str(tree), "score": score, "depth": tree.depth()}

    return panel_estimate(spark, d, f, "expression STRING, score DOUBLE, depth INT")


@query()
def transport_blend(spark, d):
    """Long-only books of two halves of the sample, blended in equal parts along correlation distance."""
    def f(x, names):
        half = len(x) // 2
        books = np.array([np.maximum(p.mean(0) - p.mean(0).min() + 1e-4, 0) for p in (x[:half], x[half:])])
        cost = np.sqrt(np.maximum(0, 2 * (1 - np.corrcoef(x, rowvar=False))))
        w = tr.regime_blend(books, np.array([0.5, 0.5]), cost)
        return [{"name": n, "weight": float(v)} for n, v in zip(names, w, strict=True)]

    return panel_estimate(spark, d, f, "name STRING, weight DOUBLE")


@query(
    """WITH b AS (SELECT upper(event_type) AS symbol, strftime(ts, '%Y-%m-%d') AS session, hour(ts) * 60 + minute(ts) AS minute, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, avg(value) AS close, count(*)::DOUBLE AS volume FROM (SELECT event_id, event_type, value, ts - INTERVAL 5 HOUR AS ts FROM events) WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 959 GROUP BY 1, 2, 3),
k AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session DESC) AS q, CASE WHEN close > 0 AND lag(close) OVER (PARTITION BY symbol, session ORDER BY minute) > 0 THEN ln(close / lag(close) OVER (PARTITION BY symbol, session ORDER BY minute)) END AS r FROM b) WHERE q <= 5)
SELECT symbol, round(sqrt(sum(r * r) * 98280 / count(r)), 5) AS realized_vol, round(arg_max(close, (session, minute)) / (sum(close * volume) / sum(volume)) - 1, 5) + 0.0 AS vwap_premium, round(ln(avg(close) FILTER (minute >= 930 AND minute < 960)) - ln(avg(close) FILTER (minute >= 810 AND minute < 870)), 5) + 0.0 AS afternoon_drift,
round((max(high) FILTER (minute < 600) - min(low) FILTER (minute < 600)) / arg_min(open, (session, minute)), 5) + 0.0 AS opening_range,
round(CASE WHEN coalesce(var_pop(ln(volume)), 0) < 1e-12 THEN 0 ELSE covar_pop(minute, ln(volume)) / sqrt(var_pop(ln(volume)) * var_pop(minute)) END, 5) + 0.0 AS volume_slope FROM k GROUP BY 1"""
)
def intraday_pack(spark, d):
    """Minute bars by the New York clock (the events are of January, five hours behind UTC), regular hours, five features."""
    from tidewater.sources.readers import load_intraday

    e = read(spark, d, "events")
    at = F.struct("ts", "event_id")
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 60_000_000_000
    m = e.groupBy(F.upper("event_type").alias("symbol"), minute.alias("ts_nanos")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.avg("value").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return packs.intraday_features(load_intraday(m)).select("symbol", *(r(c, 5).alias(c) for c in ("realized_vol", "vwap_premium", "afternoon_drift", "opening_range", "volume_slope")))


def markdown(df: DataFrame, rows: int = 20) -> list[str]:
    """A table of the first rows of a small result (a report shows the top of each list)."""
    names = df.columns
    out = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for x in df.limit(rows).collect():
        out.append("| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v) for v in x) + " |")
    return out


SECTIONS = (
    ("Data", "inventory"), ("Validation", "validation_issues"), ("Correlation", "top_pairs"), ("Information", "information_pairs"), ("Transfer entropy", "transfer_entropy_pairs"), ("Tails", "tail_dependence_pairs"),
    ("Cointegration", "engle_granger_pairs"), ("Spectrum", "random_matrix_summary"), ("Network", "minimum_spanning_tree"), ("Multifractality", "multifractal_spectra"), ("Strategies", "strategy_backtests"), ("Recommendation", "recommendation"),
)


def write_report(spark: SparkSession, sf_dir: str, queries: dict, sections=SECTIONS, title: str = "Research report") -> str:
    """The sections' results as one markdown text; a section that fails says so and the rest go on."""
    lines = [f"# {title}", ""]
    for k, (name, q) in enumerate(sections, 1):
        lines += [f"## {k}. {name}", ""]
        try:
            lines += markdown(queries[q](spark, sf_dir))
        except Exception as e:
            lines.append(f"not available: {type(e).__name__}")
        lines.append("")
    return "\n".join(lines)
