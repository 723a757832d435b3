"""The driver's tables as this domain's data: bars, series, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_NANOS = 3_600_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(column: str):
    """Nanoseconds since the epoch of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})") * 1000


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events by type; ts_nanos is the close of the bar."""
    e = read(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return (
        e.groupBy(F.upper("event_type").alias("symbol"), F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("hour"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select(((F.col("hour") + 1) * HOUR_NANOS).alias("ts_nanos"), "symbol", "open", "high", "low", "close", "volume", F.lit(3600).alias("span_secs"))
    )


BARS_SQL = """
SELECT (epoch_us(date_trunc('hour', ts)) + 3600000000) * 1000 AS ts_nanos, upper(event_type) AS symbol,
       first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume, 3600::INT AS span_secs
FROM events GROUP BY date_trunc('hour', ts), upper(event_type)
"""


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_nanos, symbol, close on the full hour grid, carried forward."""
    from tidewater.operators.joins import forward_fill

    b = bars(spark, sf_dir).select("ts_nanos", "symbol", "close")
    span = b.agg(F.min("ts_nanos").alias("a"), F.max("ts_nanos").alias("z"))
    hours = span.select(F.explode(F.sequence("a", "z", F.lit(HOUR_NANOS))).alias("ts_nanos"))
    return forward_fill(b, hours, "symbol", "ts_nanos", "close")


FILLED_SQL = f"""
SELECT ts_nanos, symbol, close FROM (
  SELECT g.ts_nanos, g.symbol, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts_nanos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
  FROM (SELECT h.ts_nanos, s.symbol FROM (SELECT unnest(range(min(ts_nanos), max(ts_nanos) + 1, {HOUR_NANOS})) AS ts_nanos FROM bars) h, (SELECT DISTINCT symbol FROM bars) s) g
  LEFT JOIN bars b USING (ts_nanos, symbol)
) WHERE close IS NOT NULL
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_nanos, series, value: daily order value of each market segment."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(nanos("o_orderdate").alias("ts_nanos"), F.lower("c_mktsegment").alias("series")).agg(F.round(F.sum("o_totalprice"), 4).alias("value"))


SERIES_SQL = """
SELECT epoch_us(o_orderdate) * 1000 AS ts_nanos, lower(c_mktsegment) AS series, round(sum(o_totalprice), 4) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their supplier; returned ones are sales."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        nanos("l_shipdate").alias("ts_nanos"),
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"),
        F.col("l_quantity").alias("qty"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 9).alias("price"),
        F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("fees"),
    )


FILLS_SQL = """
SELECT 'S' || l_suppkey AS symbol, epoch_us(l_shipdate) * 1000 AS ts_nanos, l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity AS qty,
       round(l_extendedprice / l_quantity, 9) AS price, round(l_extendedprice * l_tax, 4) AS fees
FROM lineitem
"""


def sql(body: str, *views: str) -> str:
    """A query with the named base views in front."""
    have = {"bars": BARS_SQL, "filled": FILLED_SQL, "series": SERIES_SQL, "fills": FILLS_SQL}
    if "filled" in views and "bars" not in views:
        views = ("bars", *views)
    return ("WITH " + ", ".join(f"{v} AS ({have[v]})" for v in views) + " " if views else "") + body


def by_time(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts_nanos")
