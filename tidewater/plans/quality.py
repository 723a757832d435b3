"""Queries of sources, validation, catalog, scalar families and feature packs, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater import scratch
from tidewater.functions import scalar
from tidewater.operators import validation
from tidewater.sources import generators, readers
from tidewater.plans.views import bars, fills, nanos, read, series, sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = (sql("", *views).rstrip() + " " if views else "") + oracle
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


@query(
    """, d AS (SELECT o_orderdate::DATE AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1),
v AS (SELECT l_shipdate::DATE AS day, sum(l_quantity) AS volume FROM lineitem GROUP BY 1)
SELECT day, open, high, low, close, coalesce(volume, 0) AS volume FROM d LEFT JOIN v USING (day)""".replace(", d AS", "WITH d AS", 1)
)
def daily_bars(spark, d):
    o, x = read(spark, d, "orders"), read(spark, d, "lineitem")
    v = x.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("volume"))
    return readers.daily_from_ticks(o, F.to_date("o_orderdate"), F.col("o_orderkey"), "o_totalprice", v)


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'trade' WHEN event_id % 3 = 1 THEN 'quote' ELSE 'bar' END AS kind, epoch_us(ts) * 1000 AS ts_nanos, upper(event_type) AS symbol,
CASE WHEN event_id % 3 = 0 THEN value END AS price, CASE WHEN event_id % 3 = 1 THEN round((value + value + 1) / 2, 6) END AS mid, CASE WHEN event_id % 3 = 1 THEN 0.5::DOUBLE END AS half, CASE WHEN event_id % 3 = 2 THEN 60 END::INT AS span FROM events WHERE event_id % 7 <> 0"""
)
def market_messages(spark, d):
    """Messages written from events, every seventh with a bad symbol, and decoded again."""
    e = read(spark, d, "events")
    sym = F.when(F.col("event_id") % 7 == 0, F.lit("bad symbol")).otherwise(F.upper("event_type"))
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.to_json(F.array(F.struct(F.lit("t").alias("T"), sym.alias("S"), t.alias("t"), F.col("value").alias("p"), F.lit(1.0).alias("s")))))
    text = text.when(kind == 1, F.to_json(F.array(F.struct(F.lit("q").alias("T"), sym.alias("S"), t.alias("t"), F.col("value").alias("bp"), F.lit(1.0).alias("bs"), (F.col("value") + 1).alias("ap"), F.lit(2.0).alias("as")))))
    text = text.otherwise(F.to_json(F.array(F.struct(F.lit("b").alias("T"), sym.alias("S"), t.alias("t"), F.col("value").alias("o"), F.col("value").alias("h"), F.col("value").alias("l"), F.col("value").alias("c"), F.lit(1.0).alias("v")))))
    m = readers.decode_messages(e.select(text.alias("text")), "text")
    return m.select("kind", "ts_nanos", "symbol", F.col("trade.price").alias("price"), r(scalar.quote_mid(F.col("quote.bid"), F.col("quote.ask"))).alias("mid"), r(scalar.half_spread(F.col("quote.bid"), F.col("quote.ask"))).alias("half"), F.col("bar.span_secs").alias("span"))


@query("SELECT ts_nanos, tenor, round(v / 100, 9) AS value FROM (SELECT epoch_us(l_shipdate) * 1000 AS ts_nanos, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1) UNPIVOT (v FOR tenor IN (discount, tax, quantity))")
def wide_to_long(spark, d):
    w = read(spark, d, "lineitem").groupBy(nanos("l_shipdate").alias("ts_nanos")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    return readers.melt(w, ["ts_nanos"], ["discount", "tax", "quantity"], "tenor", "value", 100.0).withColumn("value", r("value", 9))


@query("SELECT contract, count(*) AS n FROM (SELECT CASE WHEN contains(upper(p_name), 'RING') THEN 'metal' WHEN contains(upper(p_name), 'RED') THEN 'dye' WHEN contains(upper(p_name), 'WIDGET') THEN 'parts' ELSE 'other' END AS contract FROM part) GROUP BY 1")
def contract_classes(spark, d):
    c = readers.first_match(F.col("p_name"), [("ring", "metal"), ("red", "dye"), ("widget", "parts")])
    return read(spark, d, "part").groupBy(c.alias("contract")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def journal_json(spark, d):
    e = read(spark, d, "events").select("event_type", F.from_json("props", "k LONG").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS cust, unnest(list(o_orderkey ORDER BY o_orderkey)) AS order_key, unnest(list(o_orderstatus ORDER BY o_orderkey)) AS status FROM orders GROUP BY 1")
def zipped_arrays(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("a"))
    o = o.select("cust", F.transform("a", lambda x: x["o_orderkey"]).alias("order_key"), F.transform("a", lambda x: x["o_orderstatus"]).alias("status"))
    return readers.zipped(o, ["cust"], ["order_key", "status"])


@query("SELECT ts::DATE AS day, count(*) AS n_events, round(avg(value), 6) AS avg_tone, round(avg(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END), 6) AS avg_goldstein FROM events GROUP BY 1")
def daily_tone(spark, d):
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"), r(F.avg("value")).alias("avg_tone"), r(F.avg(F.when(F.col("event_type") == "error", -1).otherwise(1))).alias("avg_goldstein"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a [^>]*href=\"([^\"]*)\"', 1)) AS links, len(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1)) AS paragraphs, coalesce(len(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1)), 0) AS table_rows FROM pages")
def html_scrape(spark, d):
    p = read(spark, d, "pages")
    many = lambda x: F.size(F.regexp_extract_all("html", F.lit(x), F.lit(1))).cast("long")
    return p.select("page_id", many('(?is)<a [^>]*href="([^"]*)"').alias("links"), many(r"(?is)<p[^>]*>(.*?)</p>").alias("paragraphs"), F.size(readers.table_rows(F.col("html"))).cast("long").alias("table_rows"))


DIRTY = """, p AS (SELECT *, row_number() OVER (ORDER BY symbol, ts_nanos) AS pos FROM bars),
q AS (SELECT CASE WHEN pos % 211 = 0 THEN 'bad sym' ELSE symbol END AS symbol, CASE WHEN pos % 97 = 1 THEN ts_nanos - 3600000000000 ELSE ts_nanos END AS ts_nanos, CASE WHEN pos % 89 = 0 THEN -1.0 ELSE open END AS open, high, CASE WHEN pos % 83 = 0 THEN high + 1 ELSE low END AS low, close, volume, span_secs, pos, 'f' || pos // 400 AS file FROM p),
ok AS (SELECT * FROM q WHERE least(open, high, low, close) > 0 AND volume >= 0 AND open BETWEEN low AND high AND close BETWEEN low AND high),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts_nanos ORDER BY pos) AS k FROM ok) WHERE k = 1),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, symbol, ts_nanos ORDER BY pos) AS k FROM ok) WHERE k = 1),
fb AS (SELECT *, lag(ts_nanos) OVER (PARTITION BY file ORDER BY pos) AS b FROM fk),
fr AS (SELECT file, count(*) AS rows, count(*) FILTER (NOT (least(open, high, low, close) > 0 AND volume >= 0)) AS non_positive FROM q GROUP BY 1),
fc AS (SELECT file, rows, kept_rows, rows - kept_rows AS dropped_rows, good - kept_rows AS duplicate_rows, non_positive, rows - good - non_positive AS ohlc_violation, back AS non_monotonic, rows > kept_rows OR back > 0 AS needs_cleaning FROM fr LEFT JOIN (SELECT file, count(*) AS good FROM ok GROUP BY 1) USING (file) LEFT JOIN (SELECT file, count(*) AS kept_rows, count(*) FILTER (ts_nanos <= b) AS back FROM fb GROUP BY 1) USING (file))
"""


def dirty(spark, d):
    """Bars with faults at fixed places, numbered by symbol and time, in files of 400 rows."""
    b = bars(spark, d)
    before = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("symbol", (F.sum("n").over(Window.orderBy("symbol")) - F.col("n")).alias("before"))  # one row a symbol
    b = b.join(before, "symbol").withColumn("pos", (F.col("before") + F.row_number().over(Window.partitionBy("symbol").orderBy("ts_nanos"))).cast("long"))
    return b.select(
        F.when(F.col("pos") % 211 == 0, "bad sym").otherwise(F.col("symbol")).alias("symbol"),
        F.when(F.col("pos") % 97 == 1, F.col("ts_nanos") - 3_600_000_000_000).otherwise(F.col("ts_nanos")).alias("ts_nanos"),
        F.when(F.col("pos") % 89 == 0, -1.0).otherwise(F.col("open")).alias("open"),
        "high",
        F.when(F.col("pos") % 83 == 0, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        "close",
        "volume",
        "span_secs",
        "pos",
        F.concat(F.lit("f"), F.expr("pos div 400")).alias("file"),
    )


@query(DIRTY + "SELECT symbol, ts_nanos, open, high, low, close, volume, span_secs, pos FROM kp", "bars")
def clean_bars(spark, d):
    return validation.clean(dirty(spark, d), "pos").drop("file")


@query(DIRTY + "SELECT * FROM fc", "bars")
def validation_report(spark, d):
    return validation.file_report(dirty(spark, d), "file", "pos")


@query(DIRTY + "SELECT file, symbol, ts_nanos, close, pos, row_number() OVER (PARTITION BY file ORDER BY ts_nanos, pos) AS place FROM fk WHERE file IN (SELECT file FROM fc WHERE needs_cleaning)", "bars")
def cleaned_siblings(spark, d):
    return validation.cleaned(dirty(spark, d), "file", "pos").select("file", "symbol", "ts_nanos", "close", "pos", "place")


@query(
    DIRTY
    + """, st AS (SELECT *, ts_nanos - lag(ts_nanos) OVER (PARTITION BY symbol ORDER BY ts_nanos) AS step, CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos) > 0 AND close > 0 THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos)) END AS r, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos) AS ratio FROM kp),
md AS (SELECT symbol, median(step) AS m, count(step) AS c FROM st GROUP BY 1),
oz AS (SELECT ts_nanos, CASE WHEN count(r) OVER w >= 15 AND stddev_pop(r) OVER w > 0 THEN (r - avg(r) OVER w) / stddev_pop(r) OVER w END AS z FROM st WINDOW w AS (PARTITION BY symbol ORDER BY ts_nanos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT * FROM (SELECT 'bad_symbol' AS type, count(*) AS n, min(ts_nanos) AS first FROM q WHERE NOT regexp_full_match(symbol, '[A-Z0-9.-]{1,12}')
UNION ALL SELECT 'non_positive', count(*), min(ts_nanos) FROM q WHERE NOT (least(open, high, low, close) > 0 AND volume >= 0)
UNION ALL SELECT 'ohlc', count(*), min(ts_nanos) FROM q WHERE least(open, high, low, close) > 0 AND volume >= 0 AND NOT (open BETWEEN low AND high AND close BETWEEN low AND high)
UNION ALL SELECT 'non_monotonic', count(*), min(ts_nanos) FROM (SELECT *, lag(ts_nanos) OVER (PARTITION BY file ORDER BY pos) AS b FROM kp) WHERE ts_nanos <= b
UNION ALL SELECT 'duplicate', sum(c)::BIGINT, min(ts_nanos) FROM (SELECT symbol, ts_nanos, count(*) - 1 AS c FROM ok GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'gap', count(*), min(ts_nanos) FROM st JOIN md USING (symbol) WHERE c >= 2 AND m > 0 AND step > 5 * m
UNION ALL SELECT 'outlier', count(*), min(ts_nanos) FROM oz WHERE abs(z) > 5
UNION ALL SELECT 'split', count(*), min(ts_nanos) FROM st WHERE greatest(ratio, 1 / ratio) > 1.5) WHERE n > 0""",
    "bars",
)
def validation_issues(spark, d):
    return validation.issues(dirty(spark, d), "pos", "file")


@query("SELECT symbol FROM (SELECT DISTINCT 'S' || s_suppkey AS symbol FROM supplier) LEFT JOIN (SELECT 'S' || l_suppkey AS symbol, avg(l_quantity) AS adv FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY 1) USING (symbol) WHERE coalesce(adv, 1e308) >= 25.5 AND symbol NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def short_universe(spark, d):
    s, x = read(spark, d, "supplier"), read(spark, d, "lineitem")
    name = lambda c: F.concat(F.lit("S"), F.col(c)).alias("symbol")
    adv = x.filter("l_suppkey % 9 <> 0").groupBy(name("l_suppkey")).agg(F.avg("l_quantity").alias("adv"))
    return validation.short_universe(s.select(name("s_suppkey")).distinct(), adv, s.filter("s_acctbal < 0").select(name("s_suppkey")), 25.5)


@query("SELECT symbol, count(*) AS n_rows, min(ts_nanos) AS first_ts_nanos, max(ts_nanos) AS last_ts_nanos FROM bars GROUP BY 1", "bars")
def inventory(spark, d):
    return readers.scan_statistics(bars(spark, d), ["symbol"])


@query(
    """SELECT k[1] AS source, k[2] AS asset_class, k[3] AS frequency, count(*) AS datasets, sum(n)::BIGINT AS n_rows FROM
(SELECT CASE l_suppkey % 6 WHEN 0 THEN ['yahoo', 'equity_etf', 'daily'] WHEN 1 THEN ['coingecko', 'crypto', 'daily'] WHEN 2 THEN ['fred', 'macro', 'varies'] WHEN 3 THEN ['eia', 'commodity', 'varies'] WHEN 4 THEN ['sec_edgar', 'fundamental', 'irregular'] ELSE ['unknown', 'unknown', 'unknown'] END AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey) GROUP BY 1, 2, 3"""
)
def catalog_summary(spark, d):
    x = read(spark, d, "lineitem")
    folder = F.try_element_at(F.array(*(F.lit(f) for f in ("real", "crypto", "macro", "energy", "filings", "elsewhere"))), (F.col("l_suppkey") % 6 + 1).cast("int"))
    scans = x.groupBy(F.concat(F.lit("/lake/data/"), folder, F.lit("/s"), F.col("l_suppkey"), F.lit(".csv")).alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    scans = scans.withColumns({"dataset_id": F.col("path"), "fetched_at": F.lit("2024-01-01")})
    c = readers.catalog_table(scans).withColumn("k", readers.describe_path(F.col("path")))
    return c.groupBy("k.source", "k.asset_class", "k.frequency").agg(F.count(F.lit(1)).alias("datasets"), F.sum("n_rows").alias("n_rows"))


@query(
    """, t AS (SELECT symbol, CASE WHEN symbol = 'ERROR' THEN 'schema' END AS type, symbol <> 'ERROR' AND (ts_nanos // 3600000000000 % 50 IN (0, 1)) AS bad FROM bars)
SELECT symbol AS name, 'schema' AS type, 1 AS n FROM t WHERE type IS NOT NULL GROUP BY 1 UNION ALL SELECT symbol, 'rows', count(*) FILTER (bad) FROM t WHERE type IS NULL GROUP BY 1 HAVING count(*) FILTER (bad) > 0 UNION ALL SELECT 'EMPTY', 'empty', 1 UNION ALL SELECT 'NOTHING', 'schema', 1""",
    "bars",
)
def schema_check(spark, d):
    """A bar file a symbol, of which one has another header, one no row, one nothing at all; some rows lack a field or a number."""
    path, columns = scratch.folder(spark, "files"), readers.schemas.BAR.replace(" ", ",").split(",")[::3]
    b = bars(spark, d).select(*(F.col(c).cast("string") for c in columns))
    hour = F.expr("ts_nanos div 3600000000000") % 50
    line = F.when((F.col("symbol") != "ERROR") & (hour == 0), F.concat_ws(",", *columns[:-1])).when((F.col("symbol") != "ERROR") & (hour == 1), F.concat_ws(",", "ts_nanos", "symbol", F.lit("n/a"), *columns[3:])).otherwise(F.concat_ws(",", *columns))
    header = F.when(F.col("symbol") == "ERROR", "time," + ",".join(columns[1:])).otherwise(",".join(columns))
    rows = b.select("symbol", F.lit(1).alias("o"), line.alias("line")).union(b.select("symbol", F.lit(0).alias("o"), header.alias("line")).distinct())
    rows = rows.union(spark.createDataFrame([("EMPTY", 0, ",".join(columns)), ("NOTHING", 0, "")], "symbol string, o int, line string"))
    rows.repartition("symbol").sortWithinPartitions("symbol", "o").select("symbol", "line").write.partitionBy("symbol").text(path)
    found = readers.schema_issues(spark, path)
    return found.select(F.regexp_extract("file", "symbol=([^/]+)/", 1).alias("name"), "type", "n")


@query("SELECT symbol, ts_nanos, close + CASE WHEN ts_nanos // 3600000000000 % 5 = 0 THEN 1 ELSE 0 END AS close FROM bars", "bars")
def merge_append(spark, d):
    b = bars(spark, d).select("symbol", "ts_nanos", "close")
    new = b.filter("ts_nanos div 3600000000000 % 5 = 0").withColumn("close", F.col("close") + 1)
    return readers.merge_append(b, new, ["symbol", "ts_nanos"])


@query(
    """, e AS (SELECT event_id, ts + INTERVAL 730 DAY AS t FROM events),
o AS (SELECT event_id, t, t + CASE WHEN t::DATE >= DATE '2026-03-08' AND t::DATE < DATE '2026-11-01' THEN INTERVAL (-4) HOUR ELSE INTERVAL (-5) HOUR END AS l FROM e)
SELECT event_id, CASE WHEN isodow(l) >= 6 THEN 'Closed' WHEN l::DATE::VARCHAR IN ('2026-01-01', '2026-01-19') THEN 'Holiday' WHEN hour(l) * 60 + minute(l) < 240 OR hour(l) >= 20 THEN 'Closed' WHEN hour(l) * 60 + minute(l) < 570 THEN 'PreMarket' WHEN hour(l) < 16 THEN 'Regular' ELSE 'PostMarket' END AS status FROM o""".replace(", e AS", "WITH e AS", 1)
)
def session_status(spark, d):
    """Events moved to 2026, the year of the holiday table."""
    e = read(spark, d, "events").select("event_id", (F.col("ts") + F.make_interval(days=F.lit(730))).alias("t"))
    return e.select("event_id", scalar.session_status(F.col("t")).alias("status"))


@query(
    """SELECT p_partkey AS part, round(s / (v * sqrt(t)) * 0 + CASE WHEN s > 0 AND k > 0 AND v > 0 AND t > 0 THEN exp(-d * d / 2) / sqrt(2 * pi()) / (s * v * sqrt(t)) ELSE 0 END, 8) AS gamma,
round(least(greatest(CASE WHEN abs(k - 1200) < 1e-12 THEN 0 ELSE s / (k - 1200) END, -1e6), 1e6), 4) + 0.0 AS ratio, round(tanh(least(greatest((s - 1000) / 100, -50), 50)), 6) + 0.0 AS squashed
FROM (SELECT *, (ln(s / k) + (0.05 + v * v / 2) * t) / (v * sqrt(t)) AS d FROM (SELECT p_partkey, p_retailprice AS s, 900.0 + p_partkey % 700 AS k, 0.1 + p_size / 100.0 AS v, 0.25 AS t FROM part))"""
)
def scalar_math(spark, d):
    p = read(spark, d, "part")
    s, k, v = F.col("p_retailprice"), 900.0 + F.col("p_partkey") % 700, 0.1 + F.col("p_size") / 100.0
    return p.select(F.col("p_partkey").alias("part"), F.round(scalar.gamma(s, k, v, F.lit(0.25)), 8).alias("gamma"), r(scalar.safe_divide(s, k - 1200), 4).alias("ratio"), r(scalar.safe_tanh((s - 1000) / 100)).alias("squashed"))


@query(
    """SELECT ts_nanos, nom, tom_last, dow, fomc_eve, santa FROM (SELECT ts_nanos, (max(last::INT) OVER (ORDER BY ts_nanos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS nom, last::INT AS tom_last, isodow(day) - 1 AS dow, fomc_eve::INT AS fomc_eve, ((month(day) = 12 AND day(day) >= 26) OR (month(day) = 1 AND day(day) <= 2))::INT AS santa FROM
(SELECT *, coalesce(month(lead(day) OVER (ORDER BY ts_nanos)) <> month(day), true) AS last, coalesce(list_contains([DATE '1998-02-04', DATE '1998-03-31', DATE '1998-05-19', DATE '1998-07-01'], nd) OR EXISTS (SELECT 1 FROM (VALUES (DATE '1998-02-04'), (DATE '1998-03-31'), (DATE '1998-05-19'), (DATE '1998-07-01')) f(x) WHERE day < x AND nd >= x), false) AS fomc_eve FROM (SELECT *, lead(day) OVER (ORDER BY ts_nanos) AS nd FROM (SELECT DISTINCT epoch_us(o_orderdate) * 1000 AS ts_nanos, o_orderdate::DATE AS day FROM orders))))"""
)
def calendar_dummies(spark, d):
    from tidewater.operators.packs import calendar_features

    days = read(spark, d, "orders").select(nanos("o_orderdate").alias("ts_nanos"), F.to_date("o_orderdate").alias("day")).distinct()
    c = calendar_features(days, ("1998-02-04", "1998-03-31", "1998-05-19", "1998-07-01"))
    return c.select("ts_nanos", F.col("turn_of_month").alias("nom"), F.col("month_end").alias("tom_last"), F.col("dow").cast("long").alias("dow"), "fomc_eve", "santa")


@query(
    """, f AS (SELECT p_partkey AS symbol, 1 / NULLIF(p_size, 0) AS earnings_yield, NULLIF(p_retailprice, 0) / 100 AS debt_to_equity, ln(p_retailprice) AS log_size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 13 + 0.0 END AS growth FROM part),
u AS (SELECT symbol, feature, v::DOUBLE AS value FROM (SELECT symbol, earnings_yield::DOUBLE AS earnings_yield, debt_to_equity::DOUBLE AS debt_to_equity, log_size::DOUBLE AS log_size, growth::DOUBLE AS growth FROM f) UNPIVOT (v FOR feature IN (earnings_yield, debt_to_equity, log_size, growth))),
m AS (SELECT *, median(value) OVER (PARTITION BY feature) AS med FROM u), a AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY feature) AS mad FROM m),
z AS (SELECT symbol, feature, CASE WHEN mad > 0 THEN 0.6745 * (value - med) / mad ELSE 0 END AS z FROM a)
SELECT symbol, round((coalesce(0.4 * avg(z) FILTER (feature = 'earnings_yield'), 0) + coalesce(0.4 * avg(CASE WHEN feature = 'debt_to_equity' THEN -z ELSE z END) FILTER (feature IN ('debt_to_equity', 'log_size')), 0) + coalesce(0.2 * avg(z) FILTER (feature = 'growth'), 0)) / (CASE WHEN count(*) FILTER (feature = 'earnings_yield') > 0 THEN 0.4 ELSE 0 END + CASE WHEN count(*) FILTER (feature IN ('debt_to_equity', 'log_size')) > 0 THEN 0.4 ELSE 0 END + CASE WHEN count(*) FILTER (feature = 'growth') > 0 THEN 0.2 ELSE 0 END), 5) + 0.0 AS score FROM z GROUP BY 1""".replace(", f AS", "WITH f AS", 1)
)
def fundamental_score(spark, d):
    from tidewater.operators.packs import composite, robust_z

    p = read(spark, d, "part")
    f = p.select(F.col("p_partkey").alias("symbol"), F.try_divide(F.lit(1.0), F.col("p_size").cast("double")).alias("earnings_yield"), (F.col("p_retailprice") / 100).alias("debt_to_equity"), F.ln("p_retailprice").alias("log_size"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 13).cast("double")).alias("growth"))
    tall = readers.melt(f, ["symbol"], ["earnings_yield", "debt_to_equity", "log_size", "growth"], "feature", "value")
    score = composite(robust_z(tall), {"value": (0.4, {"earnings_yield": 1}), "quality": (0.4, {"debt_to_equity": -1, "log_size": 1}), "growth": (0.2, {"growth": 1})})
    return score.select("symbol", r("score", 5).alias("score"))


@query(
    """, o AS (SELECT l_suppkey AS u, 100.0 + l_suppkey % 5 AS spot, 0.08 + l_suppkey % 3 * 0.01 AS years, 80 + l_linenumber * 6.0 + l_partkey % 7 AS strike, 0.1 + l_discount AS iv, l_quantity AS volume, l_quantity * 2 AS oi, l_returnflag = 'R' AS put, l_linestatus = 'O' AS front FROM lineitem),
f AS (SELECT * FROM o WHERE front)
SELECT u, round(iv_atm, 6) AS iv_atm, round(skew, 6) + 0.0 AS skew, round(pc_volume, 6) AS pc_volume, round(pc_oi, 6) AS pc_oi, round(gex, 0) AS gex, round(next_atm - iv_atm, 6) + 0.0 AS term_slope
FROM (SELECT u, avg(iv) FILTER (abs(strike / spot - 1) <= 0.05) AS iv_atm, arg_min(iv, (abs(strike - 0.92 * spot), strike, iv)) FILTER (put) - arg_min(iv, (abs(strike - 1.08 * spot), strike, iv)) FILTER (NOT put) AS skew,
sum(volume) FILTER (put) / sum(volume) FILTER (NOT put) AS pc_volume, sum(oi) FILTER (put) / sum(oi) FILTER (NOT put) AS pc_oi,
sum(oi * exp(-pow((ln(spot / strike) + (0.05 + iv * iv / 2) * years) / (iv * sqrt(years)), 2) / 2) / sqrt(2 * pi()) / (spot * iv * sqrt(years)) * 100 * spot * spot) AS gex FROM f GROUP BY 1)
FULL JOIN (SELECT u, avg(iv) FILTER (NOT front AND abs(strike / spot - 1) <= 0.05) AS next_atm FROM o GROUP BY 1) USING (u)""".replace(", o AS", "WITH o AS", 1)
)
def option_features(spark, d):
    from tidewater.operators.packs import option_features as pack

    x = read(spark, d, "lineitem")
    o = x.select(F.col("l_suppkey").alias("u"), (100.0 + F.col("l_suppkey") % 5).alias("spot"), (0.08 + F.col("l_suppkey") % 3 * 0.01).alias("years"), (80 + F.col("l_linenumber") * 6.0 + F.col("l_partkey") % 7).alias("strike"), (0.1 + F.col("l_discount")).alias("iv"), F.col("l_quantity").alias("volume"), (F.col("l_quantity") * 2).alias("oi"), (F.col("l_returnflag") == "R").alias("put"), (F.col("l_linestatus") == "O").alias("front"))
    p = pack(o, ["u"])
    return p.select("u", *(r(c).alias(c) for c in ("iv_atm", "skew", "pc_volume", "pc_oi")), F.round("gex", 0).alias("gex"), r("term_slope").alias("term_slope"))


def landed(spark, df, header: bool = True) -> str:
    """df as CSV in a folder of its own, for the loaders."""
    path = scratch.folder(spark, "landed")
    df.write.option("header", header).csv(path)
    return path


@query("SELECT ts_nanos, arg_min(value, series) AS value FROM series WHERE ts_nanos // 86400000000000 % 11 <> 0 GROUP BY 1", "series")
def series_loader(spark, d):
    """Series landed as one file with bad rows, loaded as the first value of each time."""
    s = series(spark, d)
    bad = F.col("ts_nanos") / 86_400_000_000_000
    rows = s.select("ts_nanos", "series", F.when(F.floor(bad) % 11 != 0, F.col("value").cast("string")).otherwise(F.lit("n/a")).alias("value"))
    return readers.load_one(spark, landed(spark, rows.coalesce(1).sortWithinPartitions("ts_nanos", "series")))


@query("SELECT ts_nanos, value FROM series WHERE series = 'building' AND ts_nanos // 86400000000000 % 7 <> 0", "series")
def macro_loader(spark, d):
    """A macro file without a header, NaN and infinite values dropped."""
    s = series(spark, d).filter("series = 'building'")
    day = F.floor(F.col("ts_nanos") / 86_400_000_000_000)
    value = F.when(day % 14 == 0, F.lit("NaN")).when(day % 14 == 7, F.lit("Infinity")).otherwise(F.col("value").cast("string"))
    return readers.load_macro(spark, landed(spark, s.select("ts_nanos", "series", value.alias("value")).coalesce(1), header=False))


@query("SELECT epoch_us(ts::DATE::TIMESTAMP) * 1000 AS ts_nanos, count(*)::DOUBLE AS views FROM events WHERE event_type = 'view' GROUP BY 1")
def pageviews_loader(spark, d):
    e = read(spark, d, "events").filter("event_type = 'view'")
    v = e.groupBy((F.unix_date(F.to_date("ts")).cast("long") * 86_400_000_000_000).alias("ts_nanos"), F.col("event_type").alias("article")).agg(F.count(F.lit(1)).alias("views"))
    return readers.load_pageviews(spark, landed(spark, v.coalesce(1)))


TONE = """SELECT upper(event_type) AS actor, (epoch_us(date_trunc('hour', ts))) * 1000 AS ts_nanos, round(avg(value), 6) AS avg_tone, count(*) AS num_events FROM events GROUP BY 1, 2"""


@query(f"SELECT ts_nanos, avg_tone, num_events::DOUBLE AS num_events FROM ({TONE}) WHERE actor = 'CLICK'")
def tone_loader(spark, d):
    """A news file whose columns stand in another order than documented, found by name."""
    t = tone(spark, d).filter("actor = 'CLICK'").select("num_events", "actor", "ts_nanos", "avg_tone")
    return readers.load_tone(spark, landed(spark, t.coalesce(1)))


def tone(spark, d):
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 3_600_000_000_000
    return read(spark, d, "events").groupBy(F.upper("event_type").alias("actor"), hour.alias("ts_nanos")).agg(F.round(F.avg("value"), 6).alias("avg_tone"), F.count(F.lit(1)).alias("num_events"))


@query(
    f"""WITH t AS ({TONE}),
f AS (SELECT actor, ts_nanos, CASE WHEN count(*) OVER m >= 30 AND stddev_samp(avg_tone) OVER m > 1e-12 THEN (avg_tone - avg(avg_tone) OVER m) / stddev_samp(avg_tone) OVER m END AS tone_z, CASE WHEN count(*) OVER w = 7 THEN avg_tone - avg(avg_tone) OVER w END AS tone_momentum,
CASE WHEN count(*) OVER m >= 30 AND stddev_samp(num_events) OVER m > 1e-12 THEN (num_events - avg(num_events) OVER m) / stddev_samp(num_events) OVER m END AS news_volume_z FROM t
WINDOW m AS (PARTITION BY actor ORDER BY ts_nanos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY actor ORDER BY ts_nanos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT actor, ts_nanos, feature, round(value, 5) + 0.0 AS value FROM f UNPIVOT (value FOR feature IN (tone_z, tone_momentum, news_volume_z))"""
)
def tone_features(spark, d):
    from tidewater.operators.packs import tone_features as pack

    return pack(tone(spark, d), ["actor"]).withColumn("value", r("value", 5))


@query("SELECT symbol, ts_nanos, round(CASE WHEN count(*) OVER w >= 20 AND stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w END, 5) + 0.0 AS z FROM (SELECT symbol, ts_nanos, high - low AS v FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY ts_nanos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", "bars")
def topology_change(spark, d):
    """The change score of a norm by symbol (the bars' range stands for it)."""
    from tidewater.operators.packs import topology_z

    b = bars(spark, d).select("symbol", "ts_nanos", (F.col("high") - F.col("low")).alias("v"))
    return topology_z(b, ["symbol"], "ts_nanos", "v").select("symbol", "ts_nanos", r("z", 5).alias("z"))


@query("SELECT epoch_us(make_date(1990 + (k % 30)::INT, 12, 31)::TIMESTAMP) * 1000 AS ts_nanos, 'C' || k // 30 AS country, 'GDP' AS indicator, round(v, 6) AS value FROM (SELECT p_partkey AS k, p_retailprice / 3 AS v FROM part) WHERE k % 13 <> 0")
def world_bank(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("C"), F.expr("p_partkey div 30")).alias("country"), (1990 + F.col("p_partkey") % 30).cast("string").alias("date"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice") / 3).alias("value"))
    g = p.groupBy("country", F.lit("GDP").alias("indicator")).agg(F.to_json(F.collect_list(F.struct("date", "value"))).alias("items"))
    return readers.world_bank(g.select("country", "indicator", F.concat(F.lit('[{"page": 1}, '), "items", F.lit("]")).alias("payload")), "payload")


@query("SELECT epoch_us(ts::DATE::TIMESTAMP) * 1000 AS ts_nanos, event_type AS article, count(*) AS views FROM events GROUP BY 1, 2")
def article_views(spark, d):
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("article"), F.date_format("ts", "yyyyMMdd00").alias("timestamp")).agg(F.count(F.lit(1)).alias("views"))
    g = e.groupBy("article").agg(F.collect_list(F.struct("timestamp", "views")).alias("items"))
    return readers.article_views(g.select("article", F.to_json(F.struct("items")).alias("payload")), "payload")


@query("SELECT epoch_us(d::TIMESTAMP) * 1000 AS ts_nanos, a::DOUBLE AS bull_pct, b::DOUBLE AS neutral_pct, c::DOUBLE AS bear_pct, (a - c)::DOUBLE AS bull_bear_spread FROM (SELECT o_orderdate::DATE AS d, count(*) FILTER (o_orderstatus = 'O') AS a, count(*) FILTER (o_orderstatus = 'P') AS b, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1)")
def survey_sentiment(spark, d):
    """Shares written into a page as arrays and read out of it."""
    o = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "OPF"))
    page = o.select(F.format_string('<p>x [ "%s" , %d, %d ,%d] y</p>', F.col("day").cast("string"), "O", "P", "F").alias("html"))
    return readers.survey_rows(page, "html")


@query("SELECT strategy, regime, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT event_type AS strategy, CASE WHEN user_id % 3 = 0 THEN 'none' ELSE 'r' || user_id % 3 END AS regime, value AS v FROM events) GROUP BY 1, 2")
def audit_groups(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("strategy"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))).alias("regime"), F.create_map(F.lit("value"), F.col("value")).alias("features"))
    return e.groupBy("strategy", F.coalesce("regime", F.lit("none")).alias("regime")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.try_element_at("features", F.lit("value")))).alias("mean"))


@query("SELECT event_type AS stage, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.99), 4) AS p99 FROM (SELECT event_type, (value * 1000)::BIGINT AS v FROM events) GROUP BY 1")
def latency_snapshot(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("stage"), F.round(F.col("value") * 1000).cast("long").alias("v"))
    return e.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.percentile("v", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("v", F.lit(0.99)), 4).alias("p99"))


@query()
def synthetic_universes(spark, d):
    """Rows only: the generator's stream can't be written in SQL (tests hold it to known values)."""
    return generators.universes(spark, [generators.Universe(symbols=4, bars=200, seed=k, kind=kind) for k, kind in enumerate(("gbm", "momentum", "pair"), 1)])
