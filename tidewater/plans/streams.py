"""Queries that run the streaming operators over the event table to the end, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater import scratch
from tidewater.plans.portfolio import A
from tidewater.plans.views import nanos, read
from tidewater.streaming import events as st

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _stream(spark, d, name):
    """A table's folder as a stream of whole files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def _source(spark, d):
    """The events as a stream; ts gets the UTC zone that a watermark needs."""
    e = _stream(spark, d, "events")
    return e.select(F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("ts"), F.upper("event_type").alias("symbol"), "user_id", "event_id", "value", nanos("ts").alias("ts_nanos"))


def _finish(spark, stream):
    folder = scratch.folder(spark, "stream")
    st.run_once(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    """WITH RECURSIVE t AS (SELECT upper(event_type) AS symbol, epoch_us(ts) * 1000 AS ts_nanos, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
s AS (SELECT symbol, i, value AS mean, 0.0::DOUBLE AS var FROM t WHERE i = 1 UNION ALL SELECT c.symbol, c.i, s.mean + {a}::DOUBLE * (c.value - s.mean), {b}::DOUBLE * (s.var + {a}::DOUBLE * (c.value - s.mean) * (c.value - s.mean)) FROM s JOIN t c ON c.symbol = s.symbol AND c.i = s.i + 1)
SELECT symbol, ts_nanos, round(mean, 5) + 0.0 AS mean, round(var, 3) + 0.0 AS var FROM s JOIN t USING (symbol, i)""".format(a=repr(A), b=repr(1 - A))
)
def streaming_ema(spark, d):
    out = _finish(spark, st.streaming_ema(_source(spark, d), 20))
    return out.select("symbol", "ts_nanos", (F.round("mean", 5) + F.lit(0.0)).alias("mean"), (F.round("var", 3) + F.lit(0.0)).alias("var"))


MARK = "(SELECT epoch_us(max(ts)) - 600000000 FROM events)"  # the watermark after the last file, ten minutes behind


@query(
    f"""SELECT (epoch_us(date_trunc('hour', ts)) + 3600000000) * 1000 AS ts_nanos, upper(event_type) AS symbol, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
FROM events GROUP BY 1, 2 HAVING (epoch_us(any_value(date_trunc('hour', ts))) + 3600000000) <= {MARK}"""
)
def streaming_bars(spark, d):
    """Hours that the watermark has passed; the last ones stay open behind it."""
    return _finish(spark, st.tumbling_bars(_source(spark, d)))


@query(
    f"""WITH t AS (SELECT upper(event_type) AS symbol, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT symbol, epoch_us(min(ts)) * 1000 AS start_nanos, (epoch_us(max(ts)) + 1800000000) * 1000 AS end_nanos, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY symbol, k HAVING epoch_us(max(ts)) + 1800000000 <= {MARK}"""
)
def streaming_sessions(spark, d):
    out = _finish(spark, st.sessions(_source(spark, d)))
    return out.select("symbol", (F.unix_micros("start") * 1000).alias("start_nanos"), (F.unix_micros("end") * 1000).alias("end_nanos"), "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


@query(f"SELECT user_id, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1 HAVING epoch_us(max(ts)) // 1000 + 21600000 < {MARK} // 1000")
def streaming_idle(spark, d):
    """Users whose timer of six hours has run out."""
    return _finish(spark, st.idle_alerts(_source(spark, d).select("user_id", "ts"), "user_id", 21_600_000))


BATCHES = 6


def _delayed(spark, d):
    """The events as six files in order of arrival: every 17th comes three hours late, every 101st three days."""
    e = read(spark, d, "events")
    ts = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    delay = F.when(F.col("event_id") % 101 == 0, 259_200_000).when(F.col("event_id") % 17 == 0, 10_800_000).otherwise(0)
    rows = e.select("event_id", F.upper("event_type").alias("symbol"), "value", ts.alias("ts"), (F.unix_millis(ts) + delay).alias("came"))
    low, high = rows.agg(F.min("came"), F.max("came")).first()  # one row
    width = (high - low) // BATCHES + 1
    rows, path = rows.withColumn("batch", F.floor((F.col("came") - low) / width)), scratch.folder(spark, "arrivals")
    for k in range(BATCHES):
        rows.filter(F.col("batch") == k).select("event_id", "symbol", "value", "ts").coalesce(1).write.mode("append").parquet(path)
    return st.read_events(spark, path, "event_id LONG, symbol STRING, value DOUBLE, ts TIMESTAMP")


@query(
    f"""WITH e AS (SELECT event_id, upper(event_type) AS symbol, ts, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 + CASE WHEN event_id % 101 = 0 THEN 259200000 WHEN event_id % 17 = 0 THEN 10800000 ELSE 0 END AS came FROM events),
b AS (SELECT *, (came - min(came) OVER ()) // ((max(came) OVER () - min(came) OVER ()) // {BATCHES} + 1) AS batch FROM e),
m AS (SELECT batch, coalesce(max(max(ms) - 600000) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mark FROM b GROUP BY 1)
SELECT epoch_us(date_trunc('hour', ts)) * 1000 AS hour_nanos, symbol, count(*) FILTER (ms >= mark) AS on_time, count(*) FILTER (ms < mark) AS late, max(mark - ms) FILTER (ms < mark) AS worst_ms FROM b JOIN m USING (batch) GROUP BY 1, 2"""
)
def streaming_late_account(spark, d):
    """On time and late rows by hour and symbol; both together are all events."""
    told = _finish(spark, st.arrivals(_delayed(spark, d), "ts"))
    a = st.late_account(told, "ts", "1 hour", "symbol")
    return a.select((F.unix_micros("window.start") * 1000).alias("hour_nanos"), "symbol", "on_time", "late", "worst_ms")


KINDS = "CASE WHEN i = 1 THEN 'submit' WHEN i = 2 AND event_id % 11 <> 0 THEN 'accept' WHEN i = 2 THEN 'reject' WHEN event_id % 13 = 0 THEN 'cancel' WHEN event_id % 29 = 0 THEN 'submit' ELSE 'fill' END"
TTL = 259_200_000  # three days


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id || ':' || (epoch_us(ts) // 432000000000) AS k, event_id, epoch_us(ts) // 1000 AS ms, (1 + event_id % 5)::DOUBLE AS qty, value AS price FROM events),
t AS (SELECT *, {KINDS} AS kind, CASE WHEN i = 1 THEN 3 * qty ELSE qty END AS q FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, event_id) AS i FROM e)),
s AS (SELECT k, i, ms, event_id, kind, 'New' AS status, true AS legal, q AS asked, 0.0::DOUBLE AS filled, 0.0::DOUBLE AS paid, 0.0::DOUBLE AS over, ms + {TTL} AS expires, false AS ran FROM t WHERE i = 1
UNION ALL SELECT k, i, ms, event_id, kind, CASE WHEN after IS NULL THEN now WHEN kind = 'fill' AND filled + q >= asked THEN 'Filled' ELSE after END, after IS NOT NULL, asked,
CASE WHEN after IS NOT NULL AND kind = 'fill' THEN least(asked, filled + q) ELSE filled END, CASE WHEN after IS NOT NULL AND kind = 'fill' THEN paid + least(q, asked - filled) * price ELSE paid END, CASE WHEN after IS NOT NULL AND kind = 'fill' THEN q - least(q, asked - filled) ELSE 0 END, expires, ran
FROM (SELECT x.*, CASE WHEN now || ' ' || kind IN ('New accept') THEN 'Accepted' WHEN now || ' ' || kind = 'New reject' THEN 'Rejected' WHEN now IN ('New', 'Accepted', 'PartiallyFilled') AND kind = 'cancel' THEN 'Cancelled' WHEN now IN ('Accepted', 'PartiallyFilled') AND kind = 'fill' THEN 'PartiallyFilled' END AS after
  FROM (SELECT c.*, s.asked, s.filled, s.paid, s.expires, s.status IN ('New', 'Accepted', 'PartiallyFilled') AND s.expires <= c.ms AS ran, CASE WHEN s.status IN ('New', 'Accepted', 'PartiallyFilled') AND s.expires <= c.ms THEN 'Expired' ELSE s.status END AS now FROM s JOIN t c ON c.k = s.k AND c.i = s.i + 1) x)),
ends AS (SELECT k, arg_max(status, i) AS status, max(expires) AS expires, arg_max(filled, i) AS filled, arg_max(paid, i) AS paid FROM s GROUP BY 1),
mark AS (SELECT max(ms) - 600000 AS m FROM e),
x AS (SELECT k, ms AS ts_ms, event_id AS seq, kind, status, legal, filled, paid, over FROM s
UNION ALL SELECT s.k, s.expires, NULL, 'expire', 'Expired', true, p.filled, p.paid, 0 FROM s JOIN s p ON p.k = s.k AND p.i = s.i - 1 WHERE s.ran
UNION ALL SELECT k, expires, NULL, 'expire', 'Expired', true, filled, paid, 0 FROM ends, mark WHERE status IN ('New', 'Accepted', 'PartiallyFilled') AND expires <= m)
SELECT k AS order_id, ts_ms, seq, kind, status, legal, round(filled, 6) AS filled, round(CASE WHEN filled > 0 THEN paid / filled ELSE 0 END, 6) + 0.0 AS vwap, round(over, 6) AS over FROM x"""
)
def streaming_orders(spark, d):
    """An order for each user and five days: submitted, accepted or rejected, then fills, cancels and stray submits; three days to live."""
    e = _stream_of_orders(spark, d)
    out = _finish(spark, st.order_life(e))
    return out.select("order_id", "ts_ms", "seq", "kind", "status", "legal", F.round("filled", 6).alias("filled"), (F.round("vwap", 6) + F.lit(0.0)).alias("vwap"), F.round("over", 6).alias("over"))


def _stream_of_orders(spark, d):
    """Messages as a landed table, read as a stream: a message's kind follows from its place in its order."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = read(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.floor(micros / 432_000_000_000).cast("string")).alias("order_id"), F.timestamp_micros(micros).alias("ts"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 5).cast("double").alias("size"), F.col("value").alias("price"))
    i = F.row_number().over(Window.partitionBy("order_id").orderBy(F.unix_millis("ts"), "seq"))
    rows = e.withColumns({"i": i, "event_id": F.col("seq")})
    rows = rows.select("order_id", "ts", "seq", F.expr(KINDS).alias("kind"), F.when(F.col("i") == 1, 3 * F.col("size")).otherwise(F.col("size")).alias("qty"), "price", F.when(F.col("i") == 1, F.lit(TTL)).cast("long").alias("ttl_ms"))
    path = scratch.folder(spark, "messages")
    rows.write.parquet(path)
    return st.read_events(spark, path, rows.schema, files_per_batch=10_000)
