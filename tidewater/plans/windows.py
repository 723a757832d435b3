"""Queries over windows, ranks and joins, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import joins, rolling
from tidewater.plans.views import BARS_SQL, bars, filled, nanos, read, series, sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *views)
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


SCORES = """
, rr AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER o > 0 THEN ln(close / lag(close) OVER o) END AS ret FROM filled WINDOW o AS (PARTITION BY symbol ORDER BY ts_nanos)),
ss AS (SELECT ts_nanos, symbol, CASE WHEN count(ret) OVER w >= 20 AND stddev_samp(ret) OVER w > 0 THEN sum(ret) OVER w / stddev_samp(ret) OVER w END AS score FROM rr WINDOW w AS (PARTITION BY symbol ORDER BY ts_nanos ROWS 19 PRECEDING)),
zz AS (SELECT ts_nanos, symbol, score, CASE WHEN stddev_samp(score) OVER t > 0 THEN (score - avg(score) OVER t) / stddev_samp(score) OVER t ELSE 0 END AS z, count(*) OVER t AS n FROM ss WHERE score IS NOT NULL WINDOW t AS (PARTITION BY ts_nanos))
"""


@query(f"SELECT * FROM ({BARS_SQL})")
def hourly_bars(spark, d):
    return bars(spark, d)


@query("SELECT ts_nanos, symbol, round(close, 6) AS close FROM filled", "filled")
def forward_filled_grid(spark, d):
    return filled(spark, d).select("ts_nanos", "symbol", r("close").alias("close"))


@query(
    """SELECT ts_nanos, symbol, round(z, 6) AS z,
       CASE WHEN row_number() OVER (PARTITION BY ts_nanos ORDER BY round(score, 9) DESC, symbol) <= 2 THEN 1
            WHEN row_number() OVER (PARTITION BY ts_nanos ORDER BY round(score, 9), symbol DESC) <= 2 THEN -1 ELSE 0 END AS leg
FROM zz WHERE n >= 4""".join([SCORES.replace("\n, rr AS", "SELECT * FROM (WITH rr AS", 1), ")"]),
    "filled",
)
def momentum_legs(spark, d):
    s = rolling.momentum_scores(filled(spark, d)).withColumn("score", r("score", 9))
    return s.select("ts_nanos", "symbol", r("z").alias("z"), rolling.top_bottom("score", 2).alias("leg"))


def _features_sql() -> str:
    per = []
    for w in rolling.WINDOWS:
        f = f"(PARTITION BY series ORDER BY ts_nanos ROWS {w - 1} PRECEDING)"
        full = f"total > {w} AND n >= {w}"
        m = f"avg(value) OVER {f}"
        sd = f"stddev_pop(value) OVER {f}"
        per += [
            (f"ma_{w}", f"CASE WHEN {full} THEN {m} END"),
            (f"std_{w}", f"CASE WHEN {full} THEN {sd} END"),
            (f"zscore_{w}", f"CASE WHEN {full} AND {sd} > 0 THEN (value - {m}) / {sd} END"),
            (f"momentum_{w}", f"CASE WHEN total > {w} AND value > 0 AND lag(value, {w}) OVER o > 0 THEN ln(value / lag(value, {w}) OVER o) END"),
            (f"rv_ann_{w}", f"CASE WHEN {full} THEN stddev_pop(r0) OVER {f} * sqrt(252) END"),
            (f"skew_{w}", f"CASE WHEN {full} THEN CASE WHEN {sd} > 0 THEN (avg(c * c * c) OVER {f} - 3 * avg(c) OVER {f} * avg(c * c) OVER {f} + 2 * pow(avg(c) OVER {f}, 3)) / pow({sd}, 3) ELSE 0 END END"),
            (f"kurt_{w}", f"CASE WHEN {full} THEN CASE WHEN {sd} > 0 THEN (avg(c*c*c*c) OVER {f} - 4 * avg(c) OVER {f} * avg(c*c*c) OVER {f} + 6 * pow(avg(c) OVER {f}, 2) * avg(c*c) OVER {f} - 3 * pow(avg(c) OVER {f}, 4)) / pow({sd}, 4) - 3 ELSE 0 END END"),
        ]
    plain = [("level", "value"), ("log", "CASE WHEN value > 0 THEN ln(value) END"), ("diff", "value - lag(value) OVER o"), ("log_return", "rr"), ("drawdown", "CASE WHEN max(value) OVER p > 0 THEN (value - max(value) OVER p) / max(value) OVER p END")]
    cols = ", ".join(f"{e} AS {n}" for n, e in plain + per)
    names = ", ".join(n for n, _ in plain + per)
    return f"""
, a AS (SELECT *, value - avg(value) OVER (PARTITION BY series) AS c, row_number() OVER o AS n, count(*) OVER (PARTITION BY series) AS total, CASE WHEN value > 0 AND lag(value) OVER o > 0 THEN ln(value / lag(value) OVER o) END AS rr FROM series WINDOW o AS (PARTITION BY series ORDER BY ts_nanos)),
b AS (SELECT *, coalesce(rr, 0) AS r0 FROM a),
f AS (SELECT ts_nanos, series, {cols} FROM b WINDOW o AS (PARTITION BY series ORDER BY ts_nanos), p AS (PARTITION BY series ORDER BY ts_nanos ROWS UNBOUNDED PRECEDING))
SELECT ts_nanos, series, feature, round(value, 5) + 0.0 AS value FROM (UNPIVOT f ON {names} INTO NAME feature VALUE value)
"""


@query(_features_sql().replace("\n, a AS", "SELECT * FROM (WITH a AS", 1) + ")", "series")
def feature_extractor(spark, d):
    return rolling.extract_features(series(spark, d)).withColumn("value", r("value", 5) + F.lit(0.0))


@query(
    "SELECT ts_nanos, series, round(CASE WHEN lo > 0 THEN ln(value / p) ELSE value - p END, 6) AS ret FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts_nanos) AS p, min(value) OVER (PARTITION BY series) AS lo FROM series) WHERE p IS NOT NULL",
    "series",
)
def panel_returns(spark, d):
    return rolling.panel_returns(series(spark, d)).select("ts_nanos", "series", r("ret").alias("ret"))


@query(
    """SELECT ts_nanos, series, round(CASE WHEN count(*) OVER t < 2 THEN NULL WHEN stddev_samp(value) OVER t > 0 THEN (value - avg(value) OVER t) / stddev_samp(value) OVER t ELSE 0 END, 6) AS z FROM series WINDOW t AS (PARTITION BY ts_nanos)""",
    "series",
)
def cross_sectional_z(spark, d):
    return series(spark, d).select("ts_nanos", "series", r(rolling.cross_z("value")).alias("z"))


@query(
    """SELECT series, ts_nanos, rank() OVER (PARTITION BY series ORDER BY v) + (count(*) OVER (PARTITION BY series, v) - 1) / 2.0 AS avg_rank,
row_number() OVER (PARTITION BY series ORDER BY v, ts_nanos) AS ordinal,
round((rank() OVER (PARTITION BY series ORDER BY v) + (count(*) OVER (PARTITION BY series, v) - 1) / 2.0) / (count(*) OVER (PARTITION BY series) + 1), 8) AS ecdf,
least(6, ((row_number() OVER (PARTITION BY series ORDER BY v, ts_nanos) - 1) * 7) // count(*) OVER (PARTITION BY series)) AS bin
FROM (SELECT *, round(value, -4) AS v FROM series)""",
    "series",
)
def ranks_and_bins(spark, d):
    s = series(spark, d).withColumn("v", F.round("value", -4))
    return s.select(
        "series",
        "ts_nanos",
        rolling.average_rank("v", ["series"]).alias("avg_rank"),
        rolling.ordinal_rank("v", ["series"], "ts_nanos").alias("ordinal"),
        r(rolling.empirical_cdf("v", ["series"]), 8).alias("ecdf"),
        rolling.quantile_bin("v", ["series"], "ts_nanos", 7).alias("bin"),
    )


@query(
    """, p AS (SELECT ts_nanos, ln(value / lag(value) OVER (PARTITION BY series ORDER BY ts_nanos)) AS ret FROM series),
m AS (SELECT ts_nanos, avg(ret) AS m FROM p WHERE ret IS NOT NULL GROUP BY 1),
c AS (SELECT ts_nanos, CASE WHEN count(m) OVER w >= 60 THEN round(stddev_samp(m) OVER w, 9) END AS coordinate FROM m WINDOW w AS (ORDER BY ts_nanos ROWS 59 PRECEDING)),
e AS (SELECT quantile_cont(coordinate, [0.2, 0.4, 0.6, 0.8]) AS q FROM c)
SELECT ts_nanos, coordinate, CASE WHEN coordinate IS NULL THEN -1 ELSE len(list_filter(q, lambda x: coordinate >= x)) END AS bucket FROM c, e""".replace(", p AS", "SELECT * FROM (WITH p AS", 1)
    + ")",
    "series",
)
def regime_buckets(spark, d):
    c = rolling.regime_coordinate(rolling.panel_returns(series(spark, d))).withColumn("coordinate", r("coordinate", 9))
    return rolling.regime_bucket(c, "coordinate", 5)


@query(
    """SELECT series, ts_nanos,
round(CASE WHEN count(value) OVER a >= 30 AND stddev_samp(value) OVER a > 1e-12 THEN (value - avg(value) OVER a) / stddev_samp(value) OVER a END, 6) AS attention_z,
round(CASE WHEN lag(value) OVER o IS NULL THEN NULL WHEN value > 0 AND lag(value) OVER o > 0 THEN ln(value / lag(value) OVER o) ELSE 0 END, 6) AS change,
round(CASE WHEN count(value) OVER b >= 7 THEN value - avg(value) OVER b END, 4) AS tone_momentum,
round(CASE WHEN count(value) OVER c >= 20 AND stddev_pop(value) OVER c > 1e-12 THEN (value - avg(value) OVER c) / stddev_pop(value) OVER c END, 6) AS topology_z,
round(CASE WHEN count(value) OVER e >= 5 AND stddev_samp(value) OVER e > 1e-12 THEN (value - avg(value) OVER e) / stddev_samp(value) OVER e END, 6) AS shift_z
FROM series WINDOW o AS (PARTITION BY series ORDER BY ts_nanos), a AS (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), b AS (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), c AS (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), e AS (o ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
    "series",
)
def causal_windows(spark, d):
    k = ["series"]
    f = rolling.frame(k, "ts_nanos", -7, -1)
    return series(spark, d).select(
        "series",
        "ts_nanos",
        r(rolling.causal_z("value", k, "ts_nanos", 30)).alias("attention_z"),
        r(rolling.log_change("value", k, "ts_nanos")).alias("change"),
        r(F.when(F.count("value").over(f) >= 7, F.col("value") - F.avg("value").over(f)), 4).alias("tone_momentum"),
        r(rolling.causal_z("value", k, "ts_nanos", 20, population=True)).alias("topology_z"),
        r(rolling.causal_z("value", k, "ts_nanos", 60, least=5)).alias("shift_z"),
    )


@query(
    """SELECT series, ts_nanos, z FROM (SELECT series, ts_nanos, round(CASE WHEN count(value) OVER e >= 5 AND stddev_samp(value) OVER e > 1e-12 THEN (value - avg(value) OVER e) / stddev_samp(value) OVER e END, 6) AS z
FROM series WINDOW e AS (PARTITION BY series ORDER BY ts_nanos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE abs(z) >= 2""",
    "series",
)
def shift_alerts(spark, d):
    s = series(spark, d).select("series", "ts_nanos", r(rolling.causal_z("value", ["series"], "ts_nanos", 60, least=5)).alias("z"))
    return s.filter(F.abs("z") >= 2)


@query(
    """SELECT series, window_end, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_nanos) AS i, count(*) OVER (PARTITION BY series) AS total FROM series) s,
(SELECT DISTINCT window_end FROM (SELECT unnest(range(252, 100000, 21)) AS window_end UNION ALL SELECT DISTINCT count(*) OVER (PARTITION BY series) FROM series)) w
WHERE window_end <= total AND window_end >= 252 AND ((window_end - 252) % 21 = 0 OR window_end = total) AND i > window_end - 252 AND i <= window_end GROUP BY 1, 2""",
    "series",
)
def rolling_windows(spark, d):
    w = rolling.explode_windows(series(spark, d), "series", "ts_nanos", 252, 21)
    return w.groupBy("series", "window_end").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("SELECT ts_nanos, max(value) FILTER (series = 'automobile') AS automobile, max(value) FILTER (series = 'building') AS building, max(value) FILTER (series = 'furniture') AS furniture, max(value) FILTER (series = 'household') AS household, max(value) FILTER (series = 'machinery') AS machinery FROM series GROUP BY 1 HAVING count(DISTINCT series) = 5", "series")
def aligned_panel(spark, d):
    return joins.align(series(spark, d), "series", "ts_nanos", "value", ["automobile", "building", "furniture", "household", "machinery"])


@query(
    """SELECT ts_nanos, symbol, close FROM (SELECT ts_nanos, symbol, last_value(b.close IGNORE NULLS) OVER o AS close, i - last_value(CASE WHEN b.close IS NOT NULL THEN i END IGNORE NULLS) OVER o AS age
FROM (SELECT h.ts_nanos, s.symbol, row_number() OVER (PARTITION BY s.symbol ORDER BY h.ts_nanos) AS i FROM (SELECT DISTINCT ts_nanos FROM bars) h, (SELECT DISTINCT symbol FROM bars) s) g LEFT JOIN bars b USING (ts_nanos, symbol)
WINDOW o AS (PARTITION BY symbol ORDER BY ts_nanos ROWS UNBOUNDED PRECEDING)) WHERE close IS NOT NULL AND age <= 2""",
    "bars",
)
def bounded_fill(spark, d):
    b = bars(spark, d)
    return joins.forward_fill(b, b.select("ts_nanos").distinct(), "symbol", "ts_nanos", "close", budget=2)


@query("SELECT a.series AS a, b.series AS b, count(*) AS n, round(sum(a.value - b.value), 2) AS spread FROM series a JOIN series b USING (ts_nanos) WHERE a.series < b.series GROUP BY 1, 2", "series")
def all_pairs(spark, d):
    p = joins.pairs(series(spark, d), "series", "ts_nanos", "value")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("x") - F.col("y")), 2).alias("spread"))


@query(
    """, q AS (SELECT event_id, upper(event_type) AS symbol, epoch_us(ts) * 1000 AS ts_nanos, value FROM events)
SELECT q.event_id, q.symbol, q.ts_nanos, q.value, b.ts_nanos AS ts_nanos_asof, b.close FROM q ASOF LEFT JOIN bars b ON q.symbol = b.symbol AND q.ts_nanos > b.ts_nanos""".replace(", q AS", "SELECT * FROM (WITH q AS", 1)
    + ")",
    "bars",
)
def asof_exclusive(spark, d):
    e = read(spark, d, "events").select("event_id", F.upper("event_type").alias("symbol"), nanos("ts").alias("ts_nanos"), "value")
    return joins.asof(e, bars(spark, d).select("symbol", "ts_nanos", "close"), "ts_nanos", ["symbol"], ["close"], exclusive=True)


@query(
    """SELECT l_suppkey AS key, arg_min(l_orderkey * 10 + l_linenumber, (abs(l_quantity - 25), l_orderkey * 10 + l_linenumber)) AS best FROM lineitem GROUP BY 1""",
)
def nearest_row(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("best"))
    return joins.nearest(x, ["key"], F.abs(F.col("l_quantity") - 25), F.col("best"), "best")


@query(
    """SELECT a, b, ts_nanos, x, y_ahead FROM (SELECT s.series AS a, t.series AS b, ts_nanos, s.value AS x, lead(t.value, 5) OVER (PARTITION BY s.series, t.series ORDER BY ts_nanos) AS y_ahead FROM series s JOIN series t USING (ts_nanos) WHERE s.series <> t.series) WHERE y_ahead IS NOT NULL""",
    "series",
)
def lag_shift(spark, d):
    return joins.lagged_pairs(joins.pairs(series(spark, d), "series", "ts_nanos", "value", ordered=True), 5).select("a", "b", "ts_nanos", "x", "y_ahead")


@query(
    """, t AS (SELECT c_nationkey AS key, round(sum(c_acctbal), 2) AS target FROM customer WHERE c_acctbal > 0 GROUP BY 1), h AS (SELECT s_nationkey AS key, round(sum(s_acctbal), 2) AS qty FROM supplier GROUP BY 1)
SELECT key, coalesce(target, 0) AS target, coalesce(qty, 0) AS held, round(coalesce(target, 0) - coalesce(qty, 0), 2) AS delta FROM t FULL JOIN h USING (key)""".replace(", t AS", "SELECT * FROM (WITH t AS", 1)
    + ")",
)
def target_membership(spark, d):
    t = read(spark, d, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("key")).agg(r(F.sum("c_acctbal"), 2).alias("target"))
    h = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(r(F.sum("s_acctbal"), 2).alias("qty"))
    return joins.membership(t, h, "key").withColumn("delta", r("delta", 2))


@query("SELECT p_brand AS brand, p_partkey AS part, price FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY price DESC, p_partkey) AS k FROM (SELECT p_brand, p_partkey, round(p_retailprice, 2) AS price FROM part)) WHERE k <= 3")
def top_k_per_group(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), r("p_retailprice", 2).alias("price"))
    w = Window.partitionBy("brand").orderBy(F.desc("price"), "part")
    return p.withColumn("k", F.row_number().over(w)).filter("k <= 3").drop("k")


@query("SELECT k, max(side) AS sides FROM (SELECT l_partkey AS k, 1 AS side FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey, 1 FROM lineitem WHERE l_discount < 0.02) GROUP BY 1 UNION ALL SELECT k, 2 FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def set_operations(spark, d):
    x, p = read(spark, d, "lineitem"), read(spark, d, "part")
    large = x.filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    both = large.intersect(x.filter("l_discount < 0.02").select("l_partkey")).withColumn("sides", F.lit(1))
    return both.unionByName(p.select(F.col("p_partkey").alias("k")).exceptAll(large.distinct()).distinct().withColumn("sides", F.lit(2)))
