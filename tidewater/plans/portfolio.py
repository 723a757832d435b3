"""Queries of recurrences, costs, risk and performance, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import folds, joins, portfolio
from tidewater.operators.rolling import log_return
from tidewater.plans.views import bars, fills, filled, read, series, sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle if oracle.lstrip().startswith("WITH") else sql("", *views).rstrip() + " " + oracle
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


def recursive(table: str, seed: str, step: str, out: str, keys: str = "symbol", views: str = "", source: str = "") -> str:
    """A recurrence by row number: `c` is the current row, `s` the state before it."""
    from tidewater.plans.views import BARS_SQL, FILLED_SQL, FILLS_SQL, SERIES_SQL

    have = {"bars": f"bars AS ({BARS_SQL})", "filled": f"bars AS ({BARS_SQL}), filled AS ({FILLED_SQL})", "series": f"series AS ({SERIES_SQL})", "fills": f"fills AS ({FILLS_SQL})"}
    return f"""WITH RECURSIVE {have[views]}, t AS ({source}),
s AS (SELECT {keys}, i, {seed} FROM t c WHERE i = 1 UNION ALL SELECT c.{keys}, c.i, {step} FROM s JOIN t c ON c.{keys} = s.{keys} AND c.i = s.i + 1)
SELECT {out}"""


BAR_ROWS = "SELECT symbol, ts_nanos, close, row_number() OVER (PARTITION BY symbol ORDER BY ts_nanos) AS i FROM bars"
RETURN_ROWS = "SELECT symbol, ts_nanos, r, row_number() OVER (PARTITION BY symbol ORDER BY ts_nanos) AS i FROM (SELECT symbol, ts_nanos, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos)), 9) AS r FROM filled) WHERE r IS NOT NULL"
A = 1 - 2 ** (-1 / 20)


def log_returns(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts_nanos")
    return filled(spark, d).select("symbol", "ts_nanos", F.round(log_return(F.col("close"), w), 9).alias("r")).filter("r IS NOT NULL")


@query(
    recursive(
        "t",
        "close AS mean, 0.0::DOUBLE AS var",
        f"s.mean + {A!r}::DOUBLE * (c.close - s.mean), {1 - A!r}::DOUBLE * (s.var + {A!r}::DOUBLE * (c.close - s.mean) * (c.close - s.mean))",
        "symbol, ts_nanos, round(close, 6) AS close, round(mean, 6) + 0.0 AS mean, round(var, 4) + 0.0 AS var FROM s JOIN t USING (symbol, i)",
        views="bars",
        source=BAR_ROWS,
    )
)
def ema_mean_variance(spark, d):
    e = folds.ema(bars(spark, d), ["symbol"], "ts_nanos", "close", 20)
    return e.select("symbol", "ts_nanos", F.round("close", 6).alias("close"), r("mean").alias("mean"), r("var", 4).alias("var"))


@query(
    recursive(
        "t",
        "greatest(0, close - 100 - 5)::DOUBLE AS u0, least(0, close - 100 + 5)::DOUBLE AS d0, CASE WHEN u0 > 400 THEN 1 WHEN d0 < -400 THEN -1 ELSE 0 END AS broke",
        "greatest(0, CASE WHEN s.broke = 0 THEN s.u0 ELSE 0 END + c.close - 100 - 5)::DOUBLE AS u1, least(0, CASE WHEN s.broke = 0 THEN s.d0 ELSE 0 END + c.close - 100 + 5)::DOUBLE AS d1, CASE WHEN u1 > 400 THEN 1 WHEN d1 < -400 THEN -1 ELSE 0 END",
        "symbol, ts_nanos, broke, round(CASE WHEN broke = 0 THEN u0 ELSE 0 END, 5) + 0.0 AS up, round(CASE WHEN broke = 0 THEN d0 ELSE 0 END, 5) + 0.0 AS down FROM s JOIN t USING (symbol, i)",
        views="bars",
        source=BAR_ROWS,
    )
)
def cusum_breaks(spark, d):
    c = folds.cusum(bars(spark, d), ["symbol"], "ts_nanos", "close", 100, 5, 400)
    return c.select("symbol", "ts_nanos", "broke", r("up", 5).alias("up"), r("down", 5).alias("down"))


@query(
    recursive(
        "t",
        "(0.000002 / 0.1 + 0.0)::DOUBLE AS unused, 0.000002 + 0.1 * r * r + 0.85 * 0.00004 AS var",
        "0.0::DOUBLE, 0.000002 + 0.1 * (SELECT r FROM t p WHERE p.symbol = c.symbol AND p.i = c.i - 1) * (SELECT r FROM t p WHERE p.symbol = c.symbol AND p.i = c.i - 1) + 0.85 * s.var",
        "symbol, ts_nanos, round(var, 9) AS var FROM s JOIN t USING (symbol, i)",
        views="filled",
        source=RETURN_ROWS,
    ).replace("(SELECT r FROM t p WHERE p.symbol = c.symbol AND p.i = c.i - 1)", "c.before").replace("SELECT symbol, ts_nanos, r, row_number()", "SELECT symbol, ts_nanos, r, lag(r) OVER (PARTITION BY symbol ORDER BY ts_nanos) AS before, row_number()")
)
def garch_variance(spark, d):
    g = folds.garch_filter(log_returns(spark, d), ["symbol"], "ts_nanos", "r", 0.000002, 0.1, 0.85)
    return g.select("symbol", "ts_nanos", F.round("var", 9).alias("var"))


PAIR_ROWS = "SELECT a.symbol AS symbol, b.symbol AS other, ts_nanos, ln(a.close) AS x, ln(b.close) AS y, row_number() OVER (ORDER BY ts_nanos) AS i FROM filled a JOIN filled b USING (ts_nanos) WHERE a.symbol = 'CLICK' AND b.symbol = 'VIEW'"


@query(
    recursive(
        "t",
        "y / x AS beta, 1.0::DOUBLE AS p, 0.0::DOUBLE AS spread, 0.0::DOUBLE AS z",
        "s.beta + (s.p + 0.00001) * c.x / (c.x * c.x * (s.p + 0.00001) + 0.001) * (c.y - s.beta * c.x), (1 - (s.p + 0.00001) * c.x / (c.x * c.x * (s.p + 0.00001) + 0.001) * c.x) * (s.p + 0.00001), c.y - s.beta * c.x, (c.y - s.beta * c.x) / sqrt(c.x * c.x * (s.p + 0.00001) + 0.001)",
        "symbol AS a, other AS b, ts_nanos, round(beta, 6) + 0.0 AS beta, round(spread, 6) + 0.0 AS spread, round(z, 5) + 0.0 AS z FROM s JOIN t USING (symbol, i)",
        views="filled",
        source=PAIR_ROWS,
    )
)
def kalman_hedge(spark, d):
    """One pair by name, as a pair strategy runs it."""
    f = filled(spark, d).withColumn("l", F.ln("close"))
    p = joins.pairs(f, "symbol", "ts_nanos", "l").filter("a = 'CLICK' AND b = 'VIEW'")
    k = folds.kalman_beta(p, ["a", "b"], "ts_nanos", "x", "y")
    return k.select("a", "b", "ts_nanos", r("beta").alias("beta"), r("spread").alias("spread"), r("z", 5).alias("z"))


def _density(m: float, v: float) -> str:
    return f"exp(-(c.r - {m!r}::DOUBLE) * (c.r - {m!r}::DOUBLE) / (2 * {v!r}::DOUBLE)) / sqrt(2 * pi() * {v!r}::DOUBLE)"


STATES = ([0.5, 0.5], [[0.95, 0.05], [0.1, 0.9]], [0.0, 0.0], [0.25, 2.25])


@query(
    recursive(
        "t",
        f"0.5 * {_density(0.0, 0.25)} AS q0, 0.5 * {_density(0.0, 2.25)} AS q1, q0 / greatest(q0 + q1, 1e-300) AS p0, q1 / greatest(q0 + q1, 1e-300) AS p1",
        f"(s.p0 * 0.95 + s.p1 * 0.1) * {_density(0.0, 0.25)} AS n0, (s.p0 * 0.05 + s.p1 * 0.9) * {_density(0.0, 2.25)} AS n1, n0 / greatest(n0 + n1, 1e-300), n1 / greatest(n0 + n1, 1e-300)",
        "symbol, ts_nanos, round(p0, 6) + 0.0 AS calm, round(p1, 6) + 0.0 AS wild FROM s JOIN t USING (symbol, i)",
        views="filled",
        source=RETURN_ROWS,
    )
)
def markov_states(spark, d):
    m = folds.markov_filter(log_returns(spark, d), ["symbol"], "ts_nanos", "r", *STATES)
    return m.select("symbol", "ts_nanos", r(F.get("probs", F.lit(0))).alias("calm"), r(F.get("probs", F.lit(1))).alias("wild"))


@query(
    """WITH RECURSIVE t AS (SELECT upper(event_type) AS symbol, epoch_us(ts) / 3.6e9 - 473352 AS tm, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
s AS (SELECT symbol, i, tm, 0.0::DOUBLE AS r, ln(0.5::DOUBLE) - 0.5 * tm AS ll FROM t WHERE i = 1
UNION ALL SELECT c.symbol, c.i, c.tm, exp(-2 * (c.tm - s.tm)) * (1 + s.r) AS rr, s.ll + ln(0.5 + 1.2 * rr) - (0.5 * (c.tm - s.tm) + 1.2 / 2 * (1 - exp(-2 * (c.tm - s.tm))) * (1 + s.r)) FROM s JOIN t c ON c.symbol = s.symbol AND c.i = s.i + 1)
SELECT symbol, round(arg_max(ll, i), 4) AS loglik FROM s GROUP BY 1"""
)
def hawkes_loglik(spark, d):
    e = read(spark, d, "events").select(F.upper("event_type").alias("symbol"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 3.6e9D - 473352").cast("double").alias("at"))
    return folds.hawkes_loglik(e, ["symbol"], "at", 0.5, 1.2, 2.0).withColumn("loglik", F.round("loglik", 4))


F_ALPHA = 1 - 0.5 ** (1 / 12)
SERIES_ROWS = "SELECT series, ts_nanos, value, row_number() OVER (PARTITION BY series ORDER BY ts_nanos) AS i FROM series"


@query(
    recursive(
        "t",
        "value AS m, NULL::DOUBLE AS forecast",
        f"s.m + {F_ALPHA!r}::DOUBLE * (c.value - s.m), s.m",
        """series, ts_nanos, round(value - forecast, 3) + 0.0 AS surprise, round(CASE WHEN count(value - forecast) OVER w >= 2 AND stddev_samp(value - forecast) OVER w > 0 THEN (value - forecast) / stddev_samp(value - forecast) OVER w END, 5) + 0.0 AS z
FROM s JOIN t USING (series, i) WINDOW w AS (PARTITION BY series ORDER BY ts_nanos ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)""",
        keys="series",
        views="series",
        source=SERIES_ROWS,
    )
)
def macro_surprise(spark, d):
    f = folds.ewma_forecast(series(spark, d), ["series"], "ts_nanos", "value", 12).withColumn("e", F.col("value") - F.col("forecast"))
    w = Window.partitionBy("series").orderBy("ts_nanos").rowsBetween(-36, -1)
    sd = F.stddev_samp("e").over(w)
    z = F.when((F.count("e").over(w) >= 2) & (sd > 0), F.col("e") / F.when(sd > 0, sd))
    return f.select("series", "ts_nanos", r("e", 3).alias("surprise"), r(z, 5).alias("z"))


@query(
    """WITH RECURSIVE t AS (SELECT l_suppkey AS k, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity AS q, round(l_extendedprice / l_quantity, 9) AS p, round(l_extendedprice * l_tax, 4) AS f, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem),
s AS (SELECT k, i, q AS qty, p AS avg, 0.0::DOUBLE AS pnl, -q * p - f AS cash, f AS fees FROM t WHERE i = 1
UNION ALL SELECT c.k, c.i, s.qty + c.q,
CASE WHEN s.qty = 0 OR sign(s.qty) = sign(c.q) THEN (s.qty * s.avg + c.q * c.p) / (s.qty + c.q) WHEN s.qty + c.q = 0 THEN 0 WHEN sign(s.qty + c.q) = sign(s.qty) THEN s.avg ELSE c.p END,
s.pnl + CASE WHEN s.qty = 0 OR sign(s.qty) = sign(c.q) THEN 0 ELSE (c.p - s.avg) * least(abs(s.qty), abs(c.q)) * sign(s.qty) END, s.cash - c.q * c.p - c.f, s.fees + c.f FROM s JOIN t c ON c.k = s.k AND c.i = s.i + 1)
SELECT 'S' || k AS symbol, i AS n_fills, round(qty, 4) + 0.0 AS qty, round(avg, 4) + 0.0 AS avg_px, round(pnl, 2) + 0.0 AS realized_pnl, round(cash, 2) + 0.0 AS cash, round(fees, 2) + 0.0 AS fees FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS z FROM s) WHERE z = 1"""
)
def position_fold(spark, d):
    p = folds.positions(fills(spark, d), ["symbol"], ["ts_nanos", "l_orderkey", "l_linenumber"])
    return p.select("symbol", "n_fills", r("qty", 4).alias("qty"), r("avg_px", 4).alias("avg_px"), r("realized_pnl", 2).alias("realized_pnl"), r("cash", 2).alias("cash"), r("fees", 2).alias("fees"))


@query(
    """WITH RECURSIVE t AS (SELECT l_suppkey AS k, epoch_us(l_shipdate) * 1000 AS ts, l_orderkey AS o, l_linenumber AS l, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity AS q, round(l_extendedprice / l_quantity, 9) AS p, round(l_extendedprice * l_tax, 4) AS f, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem),
s AS (SELECT k, i, ts, o, l, q AS qty, p AS avg, -q * p - f AS flow FROM t WHERE i = 1
UNION ALL SELECT c.k, c.i, c.ts, c.o, c.l, s.qty + c.q, CASE WHEN s.qty = 0 OR sign(s.qty) = sign(c.q) THEN (s.qty * s.avg + c.q * c.p) / (s.qty + c.q) WHEN s.qty + c.q = 0 THEN 0 WHEN sign(s.qty + c.q) = sign(s.qty) THEN s.avg ELSE c.p END, -c.q * c.p - c.f FROM s JOIN t c ON c.k = s.k AND c.i = s.i + 1),
e AS (SELECT k, ts, 1 AS side, o, l, qty, avg, NULL::DOUBLE AS mark, flow FROM s UNION ALL SELECT k, ts, 0, NULL, NULL, NULL, NULL, round(avg(p), 6), 0 FROM t WHERE l = 1 AND o % 3 = 0 GROUP BY 1, 2),
h AS (SELECT k, ts, side, o, l, flow, coalesce(last_value(qty IGNORE NULLS) OVER w, 0) * coalesce(last_value(mark IGNORE NULLS) OVER w, last_value(avg IGNORE NULLS) OVER w, 0) AS worth FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, side, o, l ROWS UNBOUNDED PRECEDING)),
g AS (SELECT ts, flow, worth - coalesce(lag(worth) OVER w, 0) AS dw, abs(worth) - abs(coalesce(lag(worth) OVER w, 0)) AS dg FROM h WINDOW w AS (PARTITION BY k ORDER BY ts, side, o, l)),
y AS (SELECT ts, sum(flow) AS flow, sum(dw) AS dw, sum(dg) AS dg FROM g GROUP BY 1)
SELECT ts AS ts_nanos, round((1e9 + sum(flow) OVER o) / 1e6, 3) + 0.0 AS cash, round(sum(dg) OVER o / 1e6, 3) + 0.0 AS gross, round((1e9 + sum(flow + dw) OVER o) / 1e6, 3) + 0.0 AS nav, round(greatest(0, 1e9 + sum(flow) OVER o) / 1e6, 3) + 0.0 AS buying_power FROM y WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)"""
)
def portfolio_fold(spark, d):
    """The book at the end of each day, in millions, from a thousand of them: fills of all suppliers, marked now and then."""
    f = fills(spark, d)
    marks = f.filter("l_linenumber = 1 AND l_orderkey % 3 = 0").groupBy("symbol", "ts_nanos").agg(F.round(F.avg("price"), 6).alias("price"))
    p = folds.portfolio_by_time(f, marks, ["ts_nanos", "l_orderkey", "l_linenumber"], 1e9)
    return p.select("ts_nanos", *(r(F.col(c) / 1e6, 3).alias(c) for c in ("cash", "gross", "nav", "buying_power")))


@query(
    """, p AS (SELECT *, price + side * (0.01 + 0.1 * sqrt(qty / 1e6) * price) AS signed FROM fills)
SELECT symbol, count(*) AS n, round(sum(greatest(signed, 0) * qty), 1) AS traded, round(sum(CASE WHEN side < 0 THEN signed * qty * 0.0000278 + qty * 0.000166 ELSE 0 END), 4) AS cost FROM p GROUP BY 1""",
    "fills",
)
def cost_model(spark, d):
    f = fills(spark, d)
    price = portfolio.fill_price(F.col("price"), F.col("side"), F.col("qty"), F.lit(0.01), F.lit(1e6))
    f = f.withColumn("fill", price)
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("fill") * F.col("qty")), 1).alias("traded"), F.round(F.sum(portfolio.fees(F.col("side"), F.col("qty"), F.col("fill"))), 4).alias("cost"))


@query(
    """SELECT decision, count(*) AS n FROM (SELECT CASE WHEN symbol IN ('S3', 'S7') THEN 'halted' WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN qty IS NULL OR qty = 0 THEN 'quantity'
WHEN qty * price > 25000 THEN 'fat_finger' WHEN qty * price > 0.05 * 400000 THEN 'name_cap' WHEN qty * price > 15000 * 0.95 THEN 'buying_power' WHEN qty > 0.01 * 600 THEN 'adv' ELSE 'accepted' END AS decision FROM fills) GROUP BY 1""",
    "fills",
)
def pretrade_checks(spark, d):
    f = fills(spark, d)
    c = portfolio.pretrade(F.col("symbol").isin("S3", "S7"), F.col("price"), F.col("qty"), F.lit(400000.0), F.lit(15000.0), F.lit(600.0))
    return f.groupBy(c.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT symbol, ts_nanos, greatest(0, CASE WHEN volume > 8 THEN 3 ELSE 0 END, CASE WHEN high - low > 400 THEN 3 ELSE 0 END, CASE WHEN close < 1 THEN 4 ELSE 0 END) AS level FROM bars",
    "bars",
)
def kill_switch(spark, d):
    t = {"rejects": (F.col("volume") > 8, 3), "skew": (F.col("high") - F.col("low") > 400, 3), "drift": (F.col("close") < 1, 4)}
    return bars(spark, d).select("symbol", "ts_nanos", portfolio.kill_level(t).alias("level"))


@query(
    """, s AS (SELECT series, avg(r) AS m, stddev_samp(r) AS vol FROM (SELECT series, ln(value / lag(value) OVER (PARTITION BY series ORDER BY ts_nanos)) AS r FROM series) GROUP BY 1),
a AS (SELECT series, CASE WHEN series = 'building' THEN -0.6 ELSE 0.5 END AS desired, m / vol * 30 AS sharpe, vol FROM s),
b AS (SELECT series, CASE WHEN desired >= 0 THEN 1 ELSE -1 END * least(abs(desired), greatest(0, least(0.25, sharpe / vol / 2))) AS w FROM a),
c AS (SELECT series, CASE WHEN sum(abs(w)) OVER () > 1 THEN w / sum(abs(w)) OVER () ELSE w END AS w FROM b),
e AS (SELECT series, CASE WHEN abs(sum(w) OVER ()) > 0.3 THEN w - (sum(w) OVER () - sign(sum(w) OVER ()) * 0.3) / count(*) OVER () ELSE w END AS w FROM c)
SELECT series, round(w * least(1, 0.1 / 0.2), 6) + 0.0 AS weight FROM e""",
    "series",
)
def allocator(spark, d):
    w = Window.partitionBy("series").orderBy("ts_nanos")
    s = series(spark, d).select("series", log_return(F.col("value"), w).alias("r")).groupBy("series").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("vol"))
    s = s.select(F.lit("all").alias("book"), "series", F.when(F.col("series") == "building", -0.6).otherwise(0.5).alias("desired"), (F.col("m") / F.col("vol") * 30).alias("sharpe"), "vol", F.lit(0.2).alias("portfolio_vol"))
    return portfolio.allocate(s, ["book"]).select("series", r("weight").alias("weight"))


EQUITY = """, eq AS (SELECT symbol, ts_nanos, 1000 + sum(coalesce(d, 0)) OVER (PARTITION BY symbol ORDER BY ts_nanos) AS nav FROM (SELECT symbol, ts_nanos, round((close - lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos)) / 10, 6) AS d FROM filled)),
rt AS (SELECT *, CASE WHEN lag(nav) OVER o IS NULL THEN NULL WHEN lag(nav) OVER o > 0 THEN nav / lag(nav) OVER o - 1 ELSE 0 END AS r, greatest(0, (max(nav) OVER p - nav) / max(nav) OVER p) AS dd FROM eq WINDOW o AS (PARTITION BY symbol ORDER BY ts_nanos), p AS (PARTITION BY symbol ORDER BY ts_nanos ROWS UNBOUNDED PRECEDING))
"""


def equity(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts_nanos")
    e = filled(spark, d).withColumn("d", F.round((F.col("close") - F.lag("close").over(w)) / 10, 6))
    return e.select("symbol", "ts_nanos", (1000 + F.sum(F.coalesce("d", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("nav"))


K = 252 * 6.5


@query(
    EQUITY
    + f"""SELECT symbol, n AS n_periods, round(tr, 6) AS total_return, round(sd * sqrt({K}), 6) AS ann_vol, round(m / sd * sqrt({K}), 5) + 0.0 AS sharpe, round(m / dn * sqrt({K}), 5) + 0.0 AS sortino, round(mdd, 6) AS max_drawdown, round(ulcer, 6) AS ulcer,
round(hit, 6) AS hit_rate, round(g / l, 5) AS profit_factor, round(pow(1 + tr, 1 / y) - 1, 5) + 0.0 AS cagr, round((pow(1 + tr, 1 / y) - 1) / mdd, 4) + 0.0 AS calmar, round(best, 6) AS best, round(worst, 6) AS worst FROM
(SELECT symbol, count(*) AS n, last(nav ORDER BY ts_nanos) / first(nav ORDER BY ts_nanos) - 1 AS tr, avg(r) AS m, stddev_samp(r) AS sd, sqrt(avg(r * r) FILTER (r < 0)) AS dn, max(dd) AS mdd, sqrt(avg(dd * dd)) AS ulcer, avg((r > 0)::INT) AS hit, sum(r) FILTER (r > 0) AS g, -sum(r) FILTER (r < 0) AS l, (max(ts_nanos) - min(ts_nanos)) / 1e9 / ({K} * 3600) AS y, max(r) AS best, min(r) AS worst FROM rt GROUP BY 1)""",
    "filled",
)
def performance_metrics(spark, d):
    m = portfolio.metrics(equity(spark, d), ["symbol"], 3600)
    return m.select("symbol", "n_periods", *(r(c, 5 if c in ("sharpe", "sortino", "profit_factor", "cagr") else 4 if c == "calmar" else 6).alias(c) for c in ("total_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "ulcer", "hit_rate", "profit_factor", "cagr", "calmar", "best", "worst")))


REGIME = EQUITY + """, rg AS (SELECT ts_nanos, CASE WHEN (ts_nanos // 3600000000000) % 3 = 0 THEN 'bull' WHEN (ts_nanos // 3600000000000) % 3 = 1 THEN 'bear' END AS regime FROM (SELECT DISTINCT ts_nanos FROM rt)),
lb AS (SELECT rt.*, coalesce(regime, 'unknown') AS regime FROM rt LEFT JOIN rg USING (ts_nanos) WHERE r IS NOT NULL),
gr AS (SELECT *, exp(sum(ln(greatest(1 + r, 1e-12))) OVER (PARTITION BY symbol, regime ORDER BY ts_nanos)) AS g FROM lb),
dd AS (SELECT *, 1 - g / greatest(1, max(g) OVER (PARTITION BY symbol, regime ORDER BY ts_nanos)) AS d FROM gr),
rm AS (SELECT symbol, regime, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd, last(g ORDER BY ts_nanos) - 1 AS tr, max(d) AS mdd FROM dd GROUP BY 1, 2)
"""


def labelled(spark, d):
    e = equity(spark, d)
    hour = F.floor(F.col("ts_nanos") / 3_600_000_000_000) % 3
    regimes = e.select("ts_nanos").distinct().withColumns({"regime": F.when(hour == 0, "bull").when(hour == 1, "bear"), "seq": F.lit(1)}).filter("regime IS NOT NULL")
    return joins.regime_join(e, regimes)


@query(REGIME + f"SELECT symbol, regime, n, round(m, 8) + 0.0 AS mean, round(sd * sqrt({K}), 6) AS ann_vol, round(m / sd * sqrt({K}), 5) + 0.0 AS sharpe, round(tr, 6) + 0.0 AS total_return, round(mdd, 6) + 0.0 AS max_drawdown FROM rm", "filled")
def regime_performance(spark, d):
    m = portfolio.regime_metrics(labelled(spark, d), ["symbol"], 3600)
    return m.select("symbol", "regime", "n", r("mean", 8).alias("mean"), r("ann_vol").alias("ann_vol"), r("sharpe", 5).alias("sharpe"), r("total_return").alias("total_return"), r("max_drawdown").alias("max_drawdown"))


@query(
    REGIME
    + f", rk AS (SELECT regime, symbol, round(m / sd * sqrt({K}), 5) + 0.0 AS sharpe FROM rm) SELECT regime, best, sharpe, runner_up, runner_sharpe FROM (SELECT regime, symbol AS best, sharpe, lead(symbol) OVER w AS runner_up, lead(sharpe) OVER w AS runner_sharpe, row_number() OVER w AS k FROM rk WINDOW w AS (PARTITION BY regime ORDER BY sharpe DESC, symbol)) WHERE k = 1",
    "filled",
)
def recommendation(spark, d):
    m = portfolio.regime_metrics(labelled(spark, d), ["symbol"], 3600).withColumn("sharpe", r("sharpe", 5))
    return portfolio.recommend(m, "symbol")


@query(EQUITY + "SELECT symbol, round((last(nav ORDER BY ts_nanos) / first(nav ORDER BY ts_nanos) - 1) * 100, 5) + 0.0 AS total_return_pct, round(avg(r) / stddev_samp(r) * sqrt(252), 5) + 0.0 AS sharpe_daily FROM rt GROUP BY 1", "filled")
def report_summary(spark, d):
    m = portfolio.report_metrics(equity(spark, d), ["symbol"])
    return m.select("symbol", r("total_return_pct", 5).alias("total_return_pct"), r("sharpe_daily", 5).alias("sharpe_daily"))


@query(
    REGIME
    + f", rk AS (SELECT regime, symbol, round(m / sd * sqrt({K}), 5) + 0.0 AS sharpe FROM rm) SELECT regime, regime || ': ' || best || ' (' || printf('%.3f', sharpe) || '), then ' || runner_up || ' (' || printf('%.3f', runner_sharpe) || ')' AS line FROM (SELECT regime, symbol AS best, sharpe, lead(symbol) OVER w AS runner_up, lead(sharpe) OVER w AS runner_sharpe, row_number() OVER w AS k FROM rk WINDOW w AS (PARTITION BY regime ORDER BY sharpe DESC, symbol)) WHERE k = 1",
    "filled",
)
def recommendation_report(spark, d):
    return portfolio.format_report(recommendation(spark, d))


@query(
    REGIME
    + f""", oa AS (SELECT symbol, last(nav ORDER BY ts_nanos) / first(nav ORDER BY ts_nanos) - 1 AS tr, avg(r) / stddev_samp(r) * sqrt({K}) AS sharpe, avg(r) / sqrt(avg(r * r) FILTER (r < 0)) * sqrt({K}) AS sortino, max(dd) AS mdd, avg((r > 0)::INT) AS win FROM rt GROUP BY 1),
oc AS (SELECT symbol, regime, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS occ, avg((r > 0)::INT) AS win, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS pf FROM lb GROUP BY 1, 2),
ln AS (SELECT symbol, '' AS regime, printf('overall: return %.2f%%, sharpe %.3f, sortino %.3f, drawdown %.2f%%, wins %.2f%%', 100 * tr, sharpe, sortino, 100 * mdd, 100 * win) AS line FROM oa
UNION ALL SELECT symbol, regime, printf('%s: %.1f%% of the time, n %d, return %.2f%%, sharpe %.3f, drawdown %.2f%%, wins %.2f%%, profit factor %.2f', regime, 100 * occ, n, 100 * tr, m / sd * sqrt({K}), 100 * mdd, 100 * win, pf) FROM rm JOIN oc USING (symbol, regime))
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY regime)::INT - 1 AS place, line FROM ln""",
    "filled",
)
def strategy_report(spark, d):
    e = labelled(spark, d)
    return portfolio.strategy_report(portfolio.metrics(e, ["symbol"], 3600), portfolio.regime_metrics(e, ["symbol"], 3600), portfolio.regime_occupancy(e, ["symbol"]), "symbol")


@query(
    """WITH RECURSIVE """
    + sql("", "filled").removeprefix("WITH ")
    + EQUITY
    + """, t AS (SELECT symbol, ts_nanos, nav, (ts_nanos // 3600000000000) % 24 = 14 AS opens, row_number() OVER (PARTITION BY symbol ORDER BY ts_nanos) AS i, first(nav) OVER (PARTITION BY symbol ORDER BY ts_nanos) AS f FROM rt),
h AS (SELECT *, CASE WHEN (f - nav) / f >= 0.12 THEN 7 WHEN (f - nav) / f >= 0.08 THEN 6 WHEN (f - nav) / f >= 0.05 THEN 5 WHEN (f - nav) / f >= 0.035 THEN 4 WHEN (f - nav) / f >= 0.02 THEN 3 WHEN (f - nav) / f >= 0.01 THEN 2 ELSE 0 END AS hit FROM t),
s AS (SELECT symbol, i, hit AS level FROM h WHERE i = 1 UNION ALL SELECT c.symbol, c.i, CASE WHEN s.level = 7 THEN 7 ELSE greatest(CASE WHEN c.opens AND s.level BETWEEN 2 AND 4 THEN 0 ELSE s.level END, c.hit) END FROM s JOIN h c ON c.symbol = s.symbol AND c.i = s.i + 1)
SELECT symbol, ts_nanos, level FROM s JOIN h USING (symbol, i)"""
)
def loss_ladder(spark, d):
    e = equity(spark, d).withColumn("opens", F.floor(F.col("ts_nanos") / 3_600_000_000_000) % 24 == 14)
    return folds.loss_ladder(e, ["symbol"], "ts_nanos", "nav", "opens").select("symbol", "ts_nanos", "level")
