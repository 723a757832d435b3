"""Queries of dependence statistics, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import adf_p
from tidewater.operators import dependence as dep
from tidewater.operators import joins, rolling
from tidewater.plans.views import bars, filled, series, sql

QUERIES, ORACLE_SQL = {}, {}
# hourly closes carried forward, as log returns: dense pairs of symbols
RETURNS = """, rt AS (SELECT * FROM (SELECT ts_nanos, symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos)) AS r FROM filled) WHERE r IS NOT NULL),
pr AS (SELECT a.symbol AS a, b.symbol AS b, ts_nanos, a.r AS x, b.r AS y FROM rt a JOIN rt b USING (ts_nanos) WHERE a.symbol < b.symbol)
"""


def query(oracle: str | None = None, views: tuple = ("filled",), ctes: str = RETURNS):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql("", *views).rstrip() + " " + ctes + oracle
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


def return_pairs(spark, d):
    p = rolling.panel_returns(filled(spark, d), "symbol", "ts_nanos", "close")
    return joins.pairs(p, "symbol", "ts_nanos", "ret")


@query("SELECT a, b, round(corr(x, y), 6) + 0.0 AS rho FROM pr GROUP BY 1, 2")
def pearson_pairs(spark, d):
    return dep.pearson(return_pairs(spark, d)).withColumn("rho", r("rho"))


RANKED = """, rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS y, count(*) OVER (PARTITION BY a, b) AS n FROM pr) """


@query("SELECT a, b, round(corr(x, y), 6) + 0.0 AS rho FROM rk GROUP BY 1, 2", ctes=RETURNS + RANKED)
def spearman_pairs(spark, d):
    return dep.spearman(return_pairs(spark, d)).withColumn("rho", r("rho"))


@query(
    """, kd AS (SELECT l.a, l.b, sign(l.x - q.x) AS dx, sign(l.y - q.y) AS dy FROM pr l JOIN pr q ON l.a = q.a AND l.b = q.b AND l.ts_nanos < q.ts_nanos)
SELECT a, b, round(sum(dx * dy) / sqrt(count(*) FILTER (dx <> 0) * count(*) FILTER (dy <> 0)), 6) + 0.0 AS tau, round(sum(dx * dy) / count(*), 6) + 0.0 AS tau_a,
round(greatest(1, 1 / (1 - least(sum(dx * dy) / count(*), 0.999))), 6) + 0.0 AS gumbel, round(greatest(0, 2 * (sum(dx * dy) / count(*)) / (1 - least(sum(dx * dy) / count(*), 0.999))), 6) + 0.0 AS clayton FROM kd GROUP BY 1, 2"""
)
def kendall_copula(spark, d):
    k = dep.kendall(return_pairs(spark, d))
    return k.select("a", "b", r("tau").alias("tau"), r("tau_a").alias("tau_a"), r(dep.gumbel(F.col("tau_a"))).alias("gumbel"), r(dep.clayton(F.col("tau_a"))).alias("clayton"))


@query(
    """, bn AS (SELECT a, b, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN greatest(1, ceil((max(x) - min(x)) / (2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / cbrt(count(*))))) ELSE 1 END::INT AS bins FROM pr GROUP BY 1, 2),
ce AS (SELECT a, b, CASE WHEN x1 > x0 THEN least(bins - 1, floor((x - x0) / (x1 - x0) * bins)::INT) ELSE 0 END AS i, CASE WHEN y1 > y0 THEN least(bins - 1, floor((y - y0) / (y1 - y0) * bins)::INT) ELSE 0 END AS j FROM pr JOIN bn USING (a, b)),
jt AS (SELECT a, b, i, j, count(*) AS c FROM ce GROUP BY ALL), px AS (SELECT a, b, i, sum(c) AS ci FROM jt GROUP BY ALL), py AS (SELECT a, b, j, sum(c) AS cj FROM jt GROUP BY ALL), nn AS (SELECT a, b, sum(c) AS n FROM jt GROUP BY ALL),
mi AS (SELECT a, b, sum(c / n * ln(c * n / (ci * cj))) AS mi FROM jt JOIN px USING (a, b, i) JOIN py USING (a, b, j) JOIN nn USING (a, b) GROUP BY 1, 2),
bo AS (SELECT coalesce(px.a, py.a) AS a, coalesce(px.b, py.b) AS b, coalesce(ci, 0) AS ci, coalesce(cj, 0) AS cj FROM px FULL JOIN py ON px.a = py.a AND px.b = py.b AND px.i = py.j),
pq AS (SELECT a, b, ci / n AS p, cj / n AS q, (ci + cj) / n / 2 AS m FROM bo JOIN nn USING (a, b))
SELECT a, b, round(any_value(mi), 6) + 0.0 AS mi, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) + 0.0 AS h_x, round(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END), 6) + 0.0 AS h_y,
round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 6) + 0.0 AS kl, round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 6) + 0.0 AS js FROM pq JOIN mi USING (a, b) GROUP BY 1, 2"""
)
def information_pairs(spark, d):
    return dep.information(dep.binned(return_pairs(spark, d))).select("a", "b", *(r(c).alias(c) for c in ("mi", "h_x", "h_y", "kl", "js")))


@query(
    """, qb AS (SELECT a, b, ts_nanos, least(2, ((row_number() OVER (PARTITION BY a, b ORDER BY x, ts_nanos) - 1) * 3) // count(*) OVER (PARTITION BY a, b)) AS x, least(2, ((row_number() OVER (PARTITION BY a, b ORDER BY y, ts_nanos) - 1) * 3) // count(*) OVER (PARTITION BY a, b)) AS y FROM pr),
hs AS (SELECT * FROM (SELECT a, b, x, y, lead(y) OVER (PARTITION BY a, b ORDER BY ts_nanos) AS nx FROM qb) WHERE nx IS NOT NULL),
fl AS (SELECT a, b, nx, y, x, count(*) AS c FROM hs GROUP BY ALL)
SELECT a, b, round(greatest(0, sum(c / n * ln(c * cy / (cyx * cny)))), 6) + 0.0 AS te FROM (SELECT *, sum(c) OVER (PARTITION BY a, b, y, x) AS cyx, sum(c) OVER (PARTITION BY a, b, nx, y) AS cny, sum(c) OVER (PARTITION BY a, b, y) AS cy, sum(c) OVER (PARTITION BY a, b) AS n FROM fl) GROUP BY 1, 2"""
)
def transfer_entropy_pairs(spark, d):
    return dep.transfer_entropy(return_pairs(spark, d)).withColumn("te", r("te"))


def _history_sql(depths=(1, 2, 3), horizons=(1, 5, 21), bins: int = 4) -> str:
    moved = " UNION ALL ".join(f"SELECT a, b, {h} AS h, ts_nanos, x, lead(y, {h}) OVER (PARTITION BY a, b ORDER BY ts_nanos) AS y FROM pr" for h in horizons)
    rank = lambda c: f"least({bins - 1}, ((row_number() OVER (PARTITION BY a, b, h ORDER BY {c}, ts_nanos) - 1) * {bins}) // count(*) OVER (PARTITION BY a, b, h))"
    lags = ", ".join(f"lag(q{c}, {k}) OVER o AS {c}{k}" for c in "xy" for k in range(max(depths)))
    past = lambda c, k: "concat_ws(',', " + ", ".join(f"{c}{i}" for i in range(k)) + ")"
    grid = " UNION ALL ".join(f"SELECT a, b, h, {k} AS k, {l} AS l, nx, {past('y', k)} AS y, {past('x', l)} AS x FROM lg WHERE nx IS NOT NULL AND i >= {max(k, l)} AND n >= {max(k, l) + 3}" for k in depths for l in depths)
    return f""", mv AS (SELECT * FROM ({moved}) WHERE y IS NOT NULL),
qb AS (SELECT a, b, h, ts_nanos, {rank('x')} AS qx, {rank('y')} AS qy, count(*) OVER (PARTITION BY a, b, h) AS n FROM mv),
lg AS (SELECT a, b, h, n, row_number() OVER o - 1 AS i, lead(qy) OVER o AS nx, {lags} FROM qb WINDOW o AS (PARTITION BY a, b, h ORDER BY ts_nanos)),
fl AS (SELECT a, b, k, l, h, nx, y, x, count(*) AS c FROM ({grid}) GROUP BY ALL)
SELECT a, b, k, l, h, round(greatest(0, sum(c / n * ln(c * cy / (cyx * cny)))), 6) + 0.0 AS te FROM (SELECT *, sum(c) OVER (PARTITION BY a, b, k, l, h, y, x) AS cyx, sum(c) OVER (PARTITION BY a, b, k, l, h, nx, y) AS cny, sum(c) OVER (PARTITION BY a, b, k, l, h, y) AS cy, sum(c) OVER (PARTITION BY a, b, k, l, h) AS n FROM fl) GROUP BY 1, 2, 3, 4, 5"""


@query(_history_sql())
def transfer_entropy_histories(spark, d):
    return dep.history_entropy(return_pairs(spark, d), (1, 2, 3), (1, 5, 21)).withColumn("te", r("te"))


@query(
    """SELECT symbol, alpha, round(CASE WHEN alpha = 1 THEN -sum(p * ln(p)) ELSE ln(sum(pow(p, alpha))) / any_value(1 - alpha) END, 6) + 0.0 AS h FROM (SELECT symbol, c / sum(c) OVER (PARTITION BY symbol) AS p FROM (SELECT symbol, floor(close / 25) AS bin, count(*) AS c FROM filled GROUP BY 1, 2)), (SELECT unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS alpha) GROUP BY 1, 2""",
    ctes="",
)
def renyi_entropies(spark, d):
    cells = filled(spark, d).select("symbol", F.floor(F.col("close") / 25).alias("bin"))
    return dep.renyi_entropy(cells, ["symbol"], "bin", (0.5, 1.0, 2.0, 3.0)).withColumn("h", r("h"))


@query(
    """, c AS (SELECT 'pearson' AS kind, a, b, corr(x, y) AS rho FROM pr GROUP BY 1, 2, 3 UNION ALL SELECT 'spearman', a, b, corr(x, y) FROM rk GROUP BY 1, 2, 3),
m AS (SELECT kind, a AS i, b AS j, rho FROM c UNION ALL SELECT kind, b, a, rho FROM c UNION ALL SELECT DISTINCT kind, s, s, 1.0 FROM (SELECT kind, unnest([a, b]) AS s FROM c))
SELECT kind, i, j, round(rho, 6) + 0.0 AS rho FROM m""",
    ctes=RETURNS + RANKED,
)
def correlation_matrices(spark, d):
    p = return_pairs(spark, d)
    both = [dep.correlation_matrix(p, rank).withColumn("kind", F.lit(name)) for name, rank in (("pearson", False), ("spearman", True))]
    return both[0].unionByName(both[1]).select("kind", "i", "j", r("rho").alias("rho"))


@query(
    "SELECT a, b, round(count(*) FILTER (x / (n + 1) > 0.9 AND y / (n + 1) > 0.9) / (count(*) * (1 - 0.9::DOUBLE)), 6) + 0.0 AS upper, round(count(*) FILTER (x / (n + 1) <= 1 - 0.9::DOUBLE AND y / (n + 1) <= 1 - 0.9::DOUBLE) / (count(*) * (1 - 0.9::DOUBLE)), 6) + 0.0 AS lower FROM rk GROUP BY 1, 2",
    ctes=RETURNS + RANKED,
)
def tail_dependence_pairs(spark, d):
    return dep.tail_dependence(return_pairs(spark, d)).select("a", "b", r("upper").alias("upper"), r("lower").alias("lower"))


@query("SELECT a, b, count(*) AS n, round(count(*) FILTER (sign(x) = sign(y)) / count(*), 6) AS hit, round((count(*) FILTER (sign(x) = sign(y)) / count(*) - 0.5) / sqrt(0.25 / count(*)), 6) + 0.0 AS z FROM pr WHERE x <> 0 AND y <> 0 GROUP BY 1, 2 HAVING count(*) >= 30")
def sign_hit_rates(spark, d):
    s = dep.sign_hits(return_pairs(spark, d)).filter("n >= 30")
    return s.select("a", "b", "n", r("hit").alias("hit"), r("z").alias("z"))


@query(
    """, ct AS (SELECT ts_nanos, CASE WHEN count(m) OVER w >= 60 THEN round(stddev_samp(m) OVER w, 9) END AS c FROM (SELECT ts_nanos, avg(r) AS m FROM rt GROUP BY 1) WINDOW w AS (ORDER BY ts_nanos ROWS 59 PRECEDING)),
qe AS (SELECT quantile_cont(c, [0.2, 0.4, 0.6, 0.8]) AS q FROM ct), bk AS (SELECT ts_nanos, CASE WHEN c IS NULL THEN -1 ELSE len(list_filter(q, lambda v: c >= v)) END AS bucket FROM ct, qe),
cs AS (SELECT a, b, bucket, count(*) AS n, count(*) FILTER (sign(x) = sign(y)) / count(*) AS hit FROM pr JOIN bk USING (ts_nanos) WHERE x <> 0 AND y <> 0 AND bucket >= 0 GROUP BY 1, 2, 3)
SELECT a, b, count(*) FILTER (n >= 30 AND hit > 0.52) AS fires, round(max(CASE WHEN n >= 30 THEN hit ELSE 0.5 END), 6) AS best FROM cs GROUP BY 1, 2"""
)
def conditional_sign_screen(spark, d):
    returns = rolling.panel_returns(filled(spark, d), "symbol", "ts_nanos", "close")
    c = rolling.regime_coordinate(returns).withColumn("coordinate", F.round("coordinate", 9))
    b = rolling.regime_bucket(c, "coordinate", 5).select("ts_nanos", "bucket").filter("bucket >= 0")
    s = dep.sign_hits(joins.pairs(returns, "symbol", "ts_nanos", "ret").join(b, "ts_nanos"), by=("bucket",))
    return s.groupBy("a", "b").agg(F.count_if((F.col("n") >= 30) & (F.col("hit") > 0.52)).alias("fires"), r(F.max("hit")).alias("best"))


@query(
    ", dm AS (SELECT a, b, ts_nanos, x - avg(x) OVER (PARTITION BY a, b) AS x, y - avg(y) OVER (PARTITION BY a, b) AS y, row_number() OVER (PARTITION BY a, b ORDER BY ts_nanos) AS i FROM pr), lg AS (SELECT p.a, p.b, k AS lag, sum(p.x * q.y) AS c FROM dm p, unnest(range(-5, 6)) AS u(k), dm q WHERE q.a = p.a AND q.b = p.b AND q.i = p.i + k GROUP BY 1, 2, 3), sd AS (SELECT a, b, sqrt(sum(x * x)) * sqrt(sum(y * y)) AS s FROM dm GROUP BY 1, 2) "
    "SELECT a, b, lag::INT AS lag, round(c / s, 6) + 0.0 AS rho FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(abs(c / s), 12) DESC, lag) AS k FROM lg JOIN sd USING (a, b)) WHERE k = 1"
)
def lead_lag_pairs(spark, d):
    return dep.lead_lag(return_pairs(spark, d)).withColumn("rho", r("rho"))


PRICES = """, pr AS (SELECT a.symbol AS a, b.symbol AS b, ts_nanos, ln(a.close) AS x, ln(b.close) AS y FROM filled a JOIN filled b USING (ts_nanos) WHERE a.symbol < b.symbol)
"""


@query(
    """, ft AS (SELECT a, b, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM pr GROUP BY 1, 2),
er AS (SELECT a, b, ts_nanos, n, alpha, beta, y - alpha - beta * x AS e FROM pr JOIN ft USING (a, b)),
dd AS (SELECT *, lag(e) OVER (PARTITION BY a, b ORDER BY ts_nanos) AS e1, e - lag(e) OVER (PARTITION BY a, b ORDER BY ts_nanos) AS de FROM er),
st AS (SELECT a, b, n, alpha, beta, stddev_samp(e) AS resid_std, regr_slope(de, e1) / sqrt((regr_syy(de, e1) - regr_slope(de, e1) * regr_sxy(de, e1)) / (regr_count(de, e1) - 2) / regr_sxx(de, e1)) AS t FROM dd GROUP BY ALL)
SELECT a, b, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(resid_std, 6) AS resid_std, round(t, 5) AS adf_t, CASE WHEN t <= -3.43 THEN 0.005::DOUBLE END AS p FROM st""",
    ctes=PRICES,
)
def engle_granger_pairs(spark, d):
    f = filled(spark, d).withColumn("l", F.ln("close"))
    e = dep.engle_granger(joins.pairs(f, "symbol", "ts_nanos", "l"))
    return e.select("a", "b", "n", r("alpha").alias("alpha"), r("beta").alias("beta"), r("resid_std").alias("resid_std"), r("adf_t", 5).alias("adf_t"), adf_p(F.col("adf_t"), F.col("n")).alias("p"))


@query(
    """, lg AS (SELECT symbol, ln(close) AS x, lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts_nanos) AS p FROM filled),
g AS (SELECT symbol, regr_count(x, p) AS n, regr_slope(x, p) AS b, regr_intercept(x, p) AS c, regr_syy(x, p) AS syy, regr_sxy(x, p) AS sxy FROM lg GROUP BY 1)
SELECT symbol, round(-ln(b), 6) AS theta, round(c / (1 - b), 6) AS mu, round(sqrt((syy - b * sxy) / (n - 2)) * sqrt(-2 * ln(b) / (1 - b * b)), 6) AS sigma, round(ln(2) / -ln(b), 6) AS half_life FROM g WHERE n >= 9 AND b > 0 AND b < 1""",
    ctes="",
)
def ornstein_uhlenbeck(spark, d):
    o = dep.ou_fit(filled(spark, d).withColumn("l", F.ln("close")), "symbol", "l")
    return o.select("symbol", *(r(c).alias(c) for c in ("theta", "mu", "sigma", "half_life")))


@query(
    """, dm AS (SELECT a, b, ts_nanos, x - avg(x) OVER (PARTITION BY a, b) AS x, y - avg(y) OVER (PARTITION BY a, b) AS y FROM pr),
pf AS (SELECT a, b, row_number() OVER o - 1 AS i, sum(x) OVER o AS px, sum(y) OVER o AS py FROM dm WINDOW o AS (PARTITION BY a, b ORDER BY ts_nanos)),
wn AS (SELECT a, b, i // 16 AS k, count(*) AS m, regr_syy(px, i % 16) AS xx, regr_sxy(px, i % 16) AS xi, regr_sxx(px, i % 16) AS ii, regr_syy(py, i % 16) AS yy, regr_sxy(py, i % 16) AS yi, covar_pop(px, py) * count(*) AS xy FROM pf GROUP BY 1, 2, 3)
SELECT a, b, round(avg(xy - xi * yi / ii) / sqrt(avg(xx - xi * xi / ii) * avg(yy - yi * yi / ii)), 6) + 0.0 AS rho FROM wn WHERE m = 16 GROUP BY 1, 2"""
)
def dcca_pairs(spark, d):
    return dep.dcca(return_pairs(spark, d), 16).withColumn("rho", r("rho"))


@query("SELECT * FROM (SELECT a, b, round(corr(x, y), 6) + 0.0 AS rho FROM pr GROUP BY 1, 2) ORDER BY abs(rho) DESC, a, b LIMIT 5")
def top_pairs(spark, d):
    """The report's top five by |rho|: the limit is the feature."""
    p = dep.pearson(return_pairs(spark, d)).withColumn("rho", r("rho"))
    return p.orderBy(F.desc(F.abs("rho")), "a", "b").limit(5)


@query(
    "SELECT symbol, ts_nanos, n, round(mean + 1e-7, 3) AS mean, round(var + 1e-7, 2) AS var FROM (SELECT symbol, ts_nanos, count(*) OVER o AS n, avg(close) OVER o AS mean, var_samp(close) OVER o AS var FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts_nanos))",
    views=("bars",),
    ctes="",
)
def expanding_moments(spark, d):
    from tidewater.operators.rolling import frame

    w = frame(["symbol"], "ts_nanos", Window.unboundedPreceding)
    return bars(spark, d).select("symbol", "ts_nanos", F.count("close").over(w).alias("n"), F.round(F.avg("close").over(w) + 1e-7, 3).alias("mean"), F.round(F.var_samp("close").over(w) + 1e-7, 2).alias("var"))


@query(
    "SELECT a, b, ts_nanos, n, rho FROM (SELECT a, b, ts_nanos, count(*) OVER o AS n, round(coalesce(corr(x, y) OVER o, 0), 6) + 0.0 AS rho FROM pr WINDOW o AS (PARTITION BY a, b ORDER BY ts_nanos ROWS UNBOUNDED PRECEDING)) WHERE n >= 30"
)
def expanding_correlation(spark, d):
    from tidewater.operators.rolling import frame

    w = frame(["a", "b"], "ts_nanos", Window.unboundedPreceding)
    p = return_pairs(spark, d)
    vx, vy = F.var_samp("x").over(w), F.var_samp("y").over(w)
    ok = (vx > 0) & (vy > 0)
    rho = F.when(ok, F.covar_samp("x", "y").over(w) / F.sqrt(F.when(ok, vx * vy))).otherwise(F.lit(0.0))
    return p.select("a", "b", "ts_nanos", F.count("x").over(w).alias("n"), r(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho")).filter("n >= 30")


@query(
    """SELECT series, n, round(med, 4) AS med, round(mad, 4) AS mad, round(q10, 4) AS q10, round(q90, 4) AS q90, high FROM
(SELECT series, count(*) AS n, median(value) AS med, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90 FROM series GROUP BY 1)
JOIN (SELECT series, median(abs(value - m)) AS mad, count(*) FILTER (0.6745 * (value - m) > 3 * mm) AS high FROM (SELECT *, median(abs(value - m)) OVER (PARTITION BY series) AS mm FROM (SELECT *, median(value) OVER (PARTITION BY series) AS m FROM series)) GROUP BY 1) USING (series)""",
    views=("series",),
    ctes="",
)
def robust_summary(spark, d):
    s = series(spark, d)
    m = s.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("m"), F.percentile("value", F.lit(0.1)).alias("q10"), F.percentile("value", F.lit(0.9)).alias("q90"))
    dev = s.join(m, "series").withColumn("d", F.abs(F.col("value") - F.col("m")))
    mad = dev.groupBy("series").agg(F.median("d").alias("mad"))
    high = dev.join(mad, "series").groupBy("series").agg(F.count_if(0.6745 * (F.col("value") - F.col("m")) > 3 * F.col("mad")).alias("high"))
    return m.join(mad, "series").join(high, "series").select("series", "n", F.round("m", 4).alias("med"), F.round("mad", 4).alias("mad"), F.round("q10", 4).alias("q10"), F.round("q90", 4).alias("q90"), "high")
