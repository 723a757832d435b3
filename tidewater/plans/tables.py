"""Queries through the SQL table functions."""

from __future__ import annotations

from tidewater.plans import windows
from tidewater.plans.views import series, sql
from tidewater.sources import table_functions

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(windows.ORACLE_SQL["feature_extractor"])
def sql_extract_features(spark, d):
    table_functions.install(spark, series(spark, d))
    return spark.sql("SELECT ts_nanos, series, feature, round(value, 5) + 0.0D AS value FROM extract_features()")


@query(f"SELECT ts_nanos, feature, value FROM ({windows.ORACLE_SQL['feature_extractor']}) WHERE series = 'building' AND feature IN ('ma_21', 'zscore_63')")
def sql_features_of_one(spark, d):
    """One series: the condition reaches the scan, and the windows run over its rows alone."""
    table_functions.install(spark, series(spark, d))
    return spark.sql("SELECT ts_nanos, feature, round(value, 5) + 0.0D AS value FROM extract_features('building') WHERE feature IN ('ma_21', 'zscore_63')")


MOMENT = 900_000_000_000_000_000


@query(f"SELECT series, feature, max(ts_nanos) AS ts_nanos, arg_max(value, ts_nanos) AS value FROM ({windows.ORACLE_SQL['feature_extractor']}) WHERE ts_nanos <= {MOMENT} GROUP BY 1, 2")
def sql_features_at(spark, d):
    table_functions.install(spark, series(spark, d))
    return spark.sql(f"SELECT series, feature, ts_nanos, round(value, 5) + 0.0D AS value FROM features_at({MOMENT})")


@query(
    sql("", "series")
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_nanos) AS i, count(*) OVER (PARTITION BY series) AS total FROM series),
w AS (SELECT DISTINCT series, e FROM n, unnest([i, total]) AS u(e) WHERE e >= 100 AND (e = total OR (e - 100) % 30 = 0))
SELECT n.series, e AS window_end, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 3) AS sd, round(min(value), 4) AS low, round(max(value), 4) AS high FROM w JOIN n ON n.series = w.series AND i > e - 100 AND i <= e GROUP BY 1, 2"""
)
def sql_rolling_summary(spark, d):
    table_functions.install(spark, series(spark, d))
    return spark.sql("SELECT series, window_end, n, round(mean, 4) AS mean, round(sd, 3) AS sd, round(low, 4) AS low, round(high, 4) AS high FROM rolling_summary(100, 30)")
