"""Table functions for SQL over a series: features, their values at a moment, rolling windows.

install() makes temporary SQL functions that return tables, over a view of (ts_nanos,
series, value).  A function's argument is a parameter of a plan, not of Python code:
Catalyst inlines the body, so a condition on the series goes below the windows to
the scan, and columns that a query doesn't name aren't computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import rolling

FUNCTIONS = ("extract_features", "features_at", "rolling_rows", "rolling_summary")


def install(spark: SparkSession, series: DataFrame, prefix: str = "") -> None:
    """Temporary functions over series (ts_nanos, series, value), their names after prefix:

    extract_features(only STRING DEFAULT NULL): ts_nanos, series, feature, value of all
    series, or of one;
    features_at(moment BIGINT): each series' last value of each feature at or before a moment;
    rolling_rows(size INT, step INT): series, window_end, ts_nanos, value, each row once
    for each window it lies in: windows of size rows end at row size, size + step, ...
    and at the last row; series shorter than size have none;
    rolling_summary(size INT, step INT): series, window_end, n, mean, sd, low, high.
    """
    whole = Window.partitionBy("series")
    numbered = series.select("ts_nanos", "series", "value", F.row_number().over(whole.orderBy("ts_nanos")).cast("long").alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    numbered.createOrReplaceTempView(f"{prefix}series_numbered")
    rolling.extract_features(series).createOrReplaceTempView(f"{prefix}series_features")
    for body in (
        f"""{prefix}extract_features(only STRING DEFAULT NULL)
        RETURNS TABLE (ts_nanos BIGINT, series STRING, feature STRING, value DOUBLE)
        RETURN SELECT ts_nanos, series, feature, value FROM {prefix}series_features WHERE only IS NULL OR series = only""",
        f"""{prefix}features_at(moment BIGINT)
        RETURNS TABLE (series STRING, feature STRING, ts_nanos BIGINT, value DOUBLE)
        RETURN SELECT series, feature, max(ts_nanos), max_by(value, ts_nanos) FROM {prefix}series_features WHERE ts_nanos <= moment GROUP BY series, feature""",
        f"""{prefix}rolling_rows(size INT, step INT)
        RETURNS TABLE (series STRING, window_end BIGINT, ts_nanos BIGINT, value DOUBLE)
        RETURN SELECT series, explode(concat(
            CASE WHEN n >= size AND least(i - 1, n - size) DIV step >= greatest(0, i - size + step - 1) DIV step
                THEN sequence(size + step * (greatest(0, i - size + step - 1) DIV step), size + step * (least(i - 1, n - size) DIV step), CAST(step AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END,
            CASE WHEN n >= size AND (n - size) % step <> 0 AND i > n - size THEN array(n) ELSE CAST(array() AS ARRAY<BIGINT>) END
        )) AS window_end, ts_nanos, value FROM {prefix}series_numbered""",
        f"""{prefix}rolling_summary(size INT, step INT)
        RETURNS TABLE (series STRING, window_end BIGINT, n BIGINT, mean DOUBLE, sd DOUBLE, low DOUBLE, high DOUBLE)
        RETURN SELECT series, window_end, count(*), avg(value), stddev_samp(value), min(value), max(value) FROM {prefix}rolling_rows(size, step) GROUP BY series, window_end""",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
