"""Readers and writers of the data model's files, and transforms of fetched payloads.

Bars are strict (a bad row is an error), other series tolerant (a bad row is
dropped).  Network fetches are out of scope: these start from landed files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater import schemas


# How a series file's header starts -> kind, name column, value column
STARTS = {
    ("ts_nanos", "symbol"): ("bar", "symbol", "close"),
    ("ts_nanos", "series"): ("series", "series", "value"),
    ("ts_nanos", "factor"): ("factor", "factor", "value"),
    ("ts_nanos", "tenor"): ("yield", "tenor", "yield_pct"),
    ("ts_nanos", "article"): ("pageviews", "article", "views"),
}


def _header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).first()
    return [c.strip() for c in (line[0] if line else "").split(",")]


def header_kind(spark: SparkSession, path: str) -> str:
    """The kind of series a CSV file holds, by the first two names of its header; 'unknown' for any other."""
    return STARTS.get(tuple(_header(spark, path)[:2]), ("unknown",))[0]


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def load_columns(spark: SparkSession, path: str, wanted: dict[str, tuple[tuple[str, ...], int]]) -> DataFrame:
    """ts_nanos and the wanted numbers, by time; rows that don't parse, a header among them, or aren't finite are dropped.

    wanted: output name -> (names it may have in the header, column where it has none of them).
    A file needs no header: the columns then are those of the fallback.
    """
    names = _header(spark, path)
    at = lambda choices, other: next((names.index(c) for c in choices if c in names), other)
    raw = spark.read.csv(path, header=False)
    field = lambda k, kind: (F.col(raw.columns[k]).try_cast(kind) if k < len(raw.columns) else F.lit(None).cast(kind))
    out = raw.select(field(at(("ts_nanos",), 0), "long").alias("ts_nanos"), *(field(at(*w), "double").alias(n) for n, w in wanted.items()))
    return out.filter(reduce(Column.__and__, (_finite(F.col(n)) for n in wanted), F.col("ts_nanos").isNotNull())).orderBy("ts_nanos")


def load_macro(spark: SparkSession, path: str) -> DataFrame:
    """ts_nanos, value of one macro file."""
    return load_columns(spark, path, {"value": (("value",), 2)})


def load_pageviews(spark: SparkSession, path: str) -> DataFrame:
    """ts_nanos, views of one article's file."""
    return load_columns(spark, path, {"views": (("views",), 2)})


def load_tone(spark: SparkSession, path: str) -> DataFrame:
    """ts_nanos, avg_tone, num_events of a news file by actor or by day."""
    return load_columns(spark, path, {"avg_tone": (("avg_tone",), 2), "num_events": (("num_events", "n_events"), 3)})


def load_one(spark: SparkSession, path: str) -> DataFrame:
    """ts_nanos, value of a series file of a known header: the first value in file order for each time, sorted."""
    series = read_series(spark, path, strict=True)
    return series.groupBy("ts_nanos").agg(F.min_by("value", "place").alias("value")).orderBy("ts_nanos")


NEW_YORK = "America/New_York"


def load_intraday(bars: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    """Bars with session (date) and minute (of the day) on the exchange's clock, regular hours (09:30 to 16:00) only."""
    utc = F.expr("timestampadd(MICROSECOND, ts_nanos div 1000, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    out = bars.withColumn("__local", local).withColumns({"session": F.to_date("__local"), "minute": F.hour("__local") * 60 + F.minute("__local")})
    return out.filter(F.col("minute").between(570, 959)).drop("__local")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars; a row that doesn't parse raises; the volume is cut to an integer."""
    rows = spark.read.schema(schemas.BAR).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("volume", F.col("volume").cast("long").cast("double"))


def read_series(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """ts_nanos, series, value, place (order in the files) by the header; a row that doesn't parse is dropped.

    An unknown header is an error if strict, else its last column is the value.
    """
    raw = spark.read.option("header", True).csv(path)
    found = STARTS.get(tuple(c.strip() for c in raw.columns[:2]))
    if not found and strict:
        raise ValueError(f"unknown header {raw.columns}")
    _, name, value = found or ("unknown", None, raw.columns[-1])
    out = raw.select(F.col(raw.columns[0]).try_cast("long").alias("ts_nanos"), (F.col(name) if name else F.lit("value")).alias("series"), F.col(value).try_cast("double").alias("value"), F.monotonically_increasing_id().alias("place"))
    return out.filter(F.col("ts_nanos").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def bar_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every bar file under root, without universe.csv and cleaned siblings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    return files.filter(~F.col("path").endswith("/universe.csv") & ~F.col("path").endswith(".cleaned.csv"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines journal; blank lines are skipped, a bad one lands in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record STRING").json(path)


def write_bars(bars: DataFrame, path: str) -> None:
    bars.select(*(c.split()[0] for c in schemas.BAR.split(", "))).write.option("header", True).csv(path)


def write_equity(equity: DataFrame, path: str) -> None:
    """ts_nanos, nav in the order of time."""
    equity.select("ts_nanos", "nav").orderBy("ts_nanos").write.option("header", True).csv(path)


def append_features(features: DataFrame, path: str) -> None:
    """Add one snapshot's (ts_nanos, series, value) to a folder of CSV files; null and NaN values are left out."""
    rows = features.select("ts_nanos", "series", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rows.write.mode("append").option("header", True).csv(path)


def write_features(features: DataFrame, path: str) -> None:
    """Long features by series, ten decimals."""
    features.withColumn("value", F.round("value", 10)).write.partitionBy("series").parquet(path)


def write_matrix(cells: DataFrame, path: str) -> None:
    """cells (i, j, value) as one labelled CSV matrix, six decimals; the labels are the columns, so few."""
    names = [r[0] for r in cells.select("j").distinct().orderBy("j").collect()]
    wide = cells.groupBy("i").pivot("j", names).agg(F.round(F.first("value"), 6))
    wide.coalesce(1).orderBy("i").write.option("header", True).csv(path)


def write_manifest(entries: DataFrame, source: str, ts: int, path: str) -> None:
    """One JSON record {source, ts, entries}; a manifest lists the files of one run."""
    entries.agg(F.collect_list(F.struct(*entries.columns)).alias("entries")).select(F.lit(source).alias("source"), F.lit(ts).alias("ts"), "entries").coalesce(1).write.json(path)


def decode_messages(df: DataFrame, column: str) -> DataFrame:
    """kind, ts_nanos, symbol and payload of market messages (JSON arrays); others and bad symbols are dropped.

    T: t trade, q quote, b bar (one minute); a malformed array gives no row.
    Keys differ in case alone (T, t), so messages are read as maps.
    """
    m = df.select(F.explode(F.from_json(column, "array<map<string,string>>")).alias("m"))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for x in ("t", "trade", "q", "quote", "b", "bar"))), F.col("m")["T"])

    def payload(letter: str, **names: str) -> Column:
        return F.when(F.col("m")["T"] == letter, F.struct(*(F.try_element_at("m", F.lit(k)).try_cast("double").alias(n) for n, k in names.items())))

    out = m.select(
        kind.alias("kind"),
        (F.unix_micros(F.try_to_timestamp(F.try_element_at("m", F.lit("t")))) * 1000).alias("ts_nanos"),
        F.try_element_at("m", F.lit("S")).alias("symbol"),
        payload("t", price="p", size="s").alias("trade"),
        payload("q", bid="bp", ask="ap", bid_size="bs", ask_size="as").alias("quote"),
        payload("b", open="o", high="h", low="l", close="c", volume="v").withField("span_secs", F.lit(60)).alias("bar"),
    )
    return out.filter("kind IS NOT NULL AND symbol RLIKE '^[A-Z0-9.-]{1,12}$' AND ts_nanos IS NOT NULL")


def daily_from_ticks(df: DataFrame, day: Column, order: Column, price: str, volume: DataFrame | None = None) -> DataFrame:
    """day, open, high, low, close, volume: first, max, min, last of each day; volume by day, 0 where unknown."""
    out = df.groupBy(day.alias("day")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"))
    if volume is None:
        return out.withColumn("volume", F.lit(0.0))
    return out.join(volume, "day", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str, scale: float = 1.0) -> DataFrame:
    """Wide to long, nulls dropped, values divided by scale."""
    return df.unpivot(keys, columns, name, value).filter(F.col(value).isNotNull()).withColumn(value, F.col(value) / scale)


def first_match(text: Column, patterns: list[tuple[str, str]], default: str = "other") -> Column:
    """Label of the first substring that the text holds."""
    return F.coalesce(*(F.when(F.contains(F.upper(text), F.lit(k.upper())), F.lit(v)) for k, v in patterns), F.lit(default))


def any_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "MMM dd, yyyy")) -> Column:
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def sentinel(c: Column, *values: float) -> Column:
    """null for the values that mean missing."""
    return reduce(lambda x, v: F.nullif(x, F.lit(v)), values, c)


def zipped(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """One row for each place of parallel arrays."""
    return df.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("z")).select(*keys, *(f"z.{a}" for a in arrays))


def _year_end(year: Column) -> Column:
    return F.unix_micros(F.make_timestamp_ltz(year, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))) * 1000


def _day_nanos(day: Column) -> Column:
    return F.unix_date(day).cast("long") * 86_400_000_000_000


def world_bank(df: DataFrame, payload: str) -> DataFrame:
    """ts_nanos (end of the year), country, indicator, value of payloads [meta, [{date, value}]]; gaps and other dates are dropped."""
    items = F.from_json(F.get(F.from_json(payload, "array<string>"), F.lit(1)), "array<struct<date:string,value:string>>")
    out = df.select("country", "indicator", F.explode(items).alias("i"))
    out = out.select(F.col("i.date").try_cast("int").alias("year"), "country", "indicator", F.round(F.col("i.value").try_cast("double"), 6).alias("value"))
    return out.filter("year BETWEEN 1 AND 9999 AND value IS NOT NULL").select(_year_end(F.col("year")).alias("ts_nanos"), "country", "indicator", "value")


def article_views(df: DataFrame, payload: str) -> DataFrame:
    """ts_nanos (start of the day), article, views of payloads {items: [{timestamp, views}]}."""
    items = F.explode(F.from_json(payload, "items array<struct<timestamp:string,views:bigint>>")["items"])
    out = df.select("article", items.alias("i")).filter(F.length("i.timestamp") >= 10)
    day = F.to_date(F.try_to_timestamp(F.substring("i.timestamp", 1, 8), F.lit("yyyyMMdd")))
    return out.select(_day_nanos(day).alias("ts_nanos"), "article", F.col("i.views").alias("views")).filter("ts_nanos IS NOT NULL AND views IS NOT NULL")


def survey_rows(df: DataFrame, text: str) -> DataFrame:
    """ts_nanos, bull_pct, neutral_pct, bear_pct, bull_bear_spread of the arrays ["yyyy-mm-dd", bull, neutral, bear] in a page."""
    brackets = F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]"), F.lit(0))
    out = df.select(F.explode(F.transform(brackets, lambda x: F.from_json(x, "array<string>"))).alias("r")).filter(F.size("r") == 4)
    number = lambda k: F.get("r", F.lit(k)).try_cast("double")
    day = F.to_date(F.try_to_timestamp(F.get("r", F.lit(0)), F.lit("yyyy-MM-dd")))
    out = out.select(_day_nanos(day).alias("ts_nanos"), *(F.round(number(k), 4).alias(f"{n}_pct") for k, n in enumerate(("bull", "neutral", "bear"), 1)), F.round(number(1) - number(3), 4).alias("bull_bear_spread"))
    return out.na.drop()


def table_rows(html: Column, cells: str = "t[dh]") -> Column:
    """array<array<string>>: cells of each row of the tables of a page, tags stripped."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    strip = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(rf"(?is)<{cells}[^>]*>(.*?)</{cells}>"), F.lit(1)), strip))


def merge_append(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, a new one in place of an old one with the same key; of several alike in this, the one with the largest values."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *(F.desc(c) for c in old.columns if c not in keys))
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


# Directory of a dataset under data/ -> source, asset class, frequency, license
DIRECTORIES = (
    ("real", "yahoo", "equity_etf", "daily", "https://policies.yahoo.com/us/en/yahoo/terms/index.htm"),
    ("crypto", "coingecko", "crypto", "daily", "https://www.coingecko.com/en/api/documentation"),
    ("binance", "binance", "crypto", "intraday", "https://www.binance.com/en/terms"),
    ("macro", "fred", "macro", "varies", "https://fred.stlouisfed.org/legal/"),
    ("energy", "eia", "commodity", "varies", "https://www.eia.gov/about/copyrights_reuse.php"),
    ("factors", "famafrench", "factor", "daily", "https://mba.tuck.dartmouth.edu/pages/faculty/ken.french/data_library.html"),
    ("yields", "ustreasury", "rates", "daily", "https://home.treasury.gov/policy-issues/financing-the-government/interest-rate-statistics"),
    ("weather", "noaa_gsod", "alt_weather", "daily", "https://www.ncei.noaa.gov/about/legal"),
    ("worldbank", "worldbank", "macro", "annual", "https://datacatalog.worldbank.org/public-licenses"),
    ("filings", "sec_edgar", "fundamental", "irregular", "https://www.sec.gov/privacy.htm#dissemination"),
    ("cot", "cftc", "futures_positioning", "weekly", "https://www.cftc.gov/About/Disclaimer/index.htm"),
    ("pageviews", "wikimedia", "alt_search", "daily", "https://wikimediafoundation.org/wiki/Terms_of_Use"),
    ("gdelt", "gdelt", "alt_news", "daily", "https://blog.gdeltproject.org/about/"),
    ("sentiment", "aaii", "alt_sentiment", "weekly", "https://www.aaii.com/legal"),
    ("universe", "wikipedia", "constituent", "static", "https://en.wikipedia.org/wiki/Wikipedia:Reusing_Wikipedia_content"),
    ("sample", "synthetic", "synthetic", "minute", "internal"),
)
PLACE = ("source", "asset_class", "frequency", "license_url")


def describe_path(path: Column) -> Column:
    """struct<source, asset_class, frequency, license_url> by the directory after data/, 'unknown' (no license) where it isn't known."""
    top = F.regexp_extract(path, r"data/([^/]+)/", 1)
    entry = F.create_map(*(x for d, *values in DIRECTORIES for x in (F.lit(d), F.struct(*(F.lit(v).alias(n) for n, v in zip(PLACE, values, strict=True))))))
    unknown = F.struct(*(F.lit("" if n == "license_url" else "unknown").alias(n) for n in PLACE))
    return F.coalesce(F.try_element_at(entry, top), unknown)


def schema_issues(spark: SparkSession, path: str) -> DataFrame:
    """file, type, n, got: what keeps the bar files under path from being read as such.

    schema: the header isn't that of bars (got: the header; nothing else is told of the
    file); empty: no row behind it; rows: n rows without eight fields or with a field
    that isn't a number.  A line's place in its file comes from its block and its number in the task.
    """
    names = [c.split()[0] for c in schemas.BAR.split(", ")]
    # lines of a file keep their order within a task, and tasks that of its blocks; blank files have no line, so files are listed too
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", "_metadata.file_path", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    fields = F.split("value", ",")
    numbers = [F.get(fields, F.lit(k)).try_cast("long" if k == 0 else "double").isNotNull() for k in (0, 2, 3, 4, 5, 6)]
    good = (F.size(fields) == len(names)) & reduce(Column.__and__, numbers)
    heads = lines.groupBy("file_path").agg(F.min_by("value", "place").alias("got"), F.min("place").alias("first"))
    told = lines.join(heads, "file_path").groupBy("file_path").agg(F.first("got").alias("got"), F.count_if(F.col("place") > F.col("first")).alias("rows"), F.count_if((F.col("place") > F.col("first")) & ~F.coalesce(good, F.lit(False))).alias("bad"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file_path"))  # names alone, no content
    told = files.join(told, "file_path", "left")
    wrong = F.coalesce(F.col("got"), F.lit("")) != ",".join(names)
    kind = F.when(wrong, "schema").when(F.col("rows") == 0, "empty").when(F.col("bad") > 0, "rows")
    return told.select(F.col("file_path").alias("file"), kind.alias("type"), F.when(kind == "rows", F.col("bad")).otherwise(F.lit(1)).cast("long").alias("n"), F.when(wrong, F.coalesce("got", F.lit(""))).alias("got")).filter("type IS NOT NULL")


def catalog_table(scans: DataFrame) -> DataFrame:
    """One row a dataset: the last scan of each dataset_id that has rows."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc("fetched_at"))
    return scans.filter("n_rows > 0").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def scan_statistics(df: DataFrame, keys: list[str], time: str = "ts_nanos") -> DataFrame:
    """n_rows, first and last time (0 where there is none) for each key."""
    t = F.expr(f"try_cast({time} AS BIGINT)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.min(t), F.lit(0)).alias("first_ts_nanos"), F.coalesce(F.max(t), F.lit(0)).alias("last_ts_nanos"))
