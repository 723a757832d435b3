"""Feature packs: calendar, fundamentals, options, intraday, sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import gamma


def calendar_features(days: DataFrame, meetings: tuple[str, ...]) -> DataFrame:
    """days (ts_nanos, day: a calendar of distinct days) with month_end, turn_of_month, dow, month, fomc_eve, santa.

    A calendar has one row a day, so its one-partition window stays small.
    The turn of the month is the last trading day, the final row always, and the
    three rows after it; the eve of a meeting is the last day before it.
    """
    o = Window.orderBy("ts_nanos")
    ahead = F.lead("day").over(o)
    d = days.withColumns({"month_end": F.coalesce(F.month(ahead) != F.month("day"), F.lit(True)).cast("int"), "__next": ahead})
    d = d.withColumn("turn_of_month", F.max("month_end").over(o.rowsBetween(-3, 0)))
    eve = F.exists(F.lit(list(meetings)), lambda m: (F.col("day") < m.cast("date")) & (F.col("__next") >= m.cast("date")))
    santa = ((F.month("day") == 12) & (F.dayofmonth("day") >= 26)) | ((F.month("day") == 1) & (F.dayofmonth("day") <= 2))
    return d.withColumns({"dow": F.weekday("day"), "month": F.month("day"), "fomc_eve": F.coalesce(eve, F.lit(False)).cast("int"), "santa": santa.cast("int")}).drop("__next")


def robust_z(tall: DataFrame) -> DataFrame:
    """symbol, feature, z = 0.6745 (value - median) / MAD over the symbols that have the feature; 0 where MAD is 0."""
    m = tall.groupBy("feature").agg(F.median("value").alias("med"))
    d = tall.join(m, "feature")
    mad = d.groupBy("feature").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    d = d.join(mad, "feature")
    return d.select("symbol", "feature", F.when(F.col("mad") > 0, 0.6745 * (F.col("value") - F.col("med")) / F.when(F.col("mad") > 0, F.col("mad"))).otherwise(F.lit(0.0)).alias("z"))


def composite(z: DataFrame, buckets: dict[str, tuple[float, dict[str, int]]]) -> DataFrame:
    """symbol, score: weighted mean of bucket means (features with signs), weights spread over the buckets present."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for weight, features in buckets.values():
        signed = F.avg(F.coalesce(*(F.when(F.col("feature") == f, F.col("z") * s) for f, s in features.items())))
        top, bottom = top + F.coalesce(signed * weight, F.lit(0.0)), bottom + F.when(signed.isNotNull(), weight).otherwise(0.0)
    return z.groupBy("symbol").agg(F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(F.lit(0.0)).alias("score"))


def option_features(chain: DataFrame, keys: list[str], spot: float | None = None, years: float | None = None) -> DataFrame:
    """iv_atm (strikes within 5 %), skew (put at 92 % less call at 108 %), put/call volume and interest, gamma exposure, term_slope.

    Columns spot and years, where the chain has them, say the underlying's price and the
    front expiry's time for each row; else the arguments do.  With a column `front`
    (boolean), all but term_slope are of the front expiry, and term_slope is the
    next one's iv_atm less the front's; without it term_slope is null.
    """
    put = F.col("put")
    s = F.col("spot") if spot is None else F.lit(float(spot))
    y = F.col("years") if years is None else F.lit(float(years))
    front = F.col("front") if "front" in chain.columns else F.lit(True)

    def near(strike: float):
        return F.struct(F.abs(F.col("strike") - strike * s), F.col("strike"), F.col("iv"))

    def side(c: str):
        return F.try_divide(F.sum(F.when(front & put, F.col(c))), F.sum(F.when(front & ~put, F.col(c))))

    def atm(which):
        return F.avg(F.when(which & (F.abs(F.col("strike") / s - 1) <= 0.05), F.col("iv")))

    def at(which, strike: float):
        return F.min_by(F.when(which, F.col("iv")), F.when(which, near(strike)))

    g = gamma(s, F.col("strike"), F.col("iv"), y)
    return chain.filter("strike > 0 AND iv > 0").groupBy(*keys).agg(
        atm(front).alias("iv_atm"),
        (at(front & put, 0.92) - at(front & ~put, 1.08)).alias("skew"),
        side("volume").alias("pc_volume"),
        side("oi").alias("pc_oi"),
        F.sum(F.when(front, F.col("oi") * g * 100 * s * s)).alias("gex"),
        (atm(~front) - atm(front)).alias("term_slope"),
    )


def intraday_features(bars: DataFrame, sessions: int = 5) -> DataFrame:
    """symbol, realized_vol, vwap_premium, opening_range, afternoon_drift, volume_slope over the last sessions.

    bars: symbol, session (date), minute (of the day), open, high, low, close, volume, in regular hours.
    """
    last = Window.partitionBy("symbol").orderBy(F.desc("session"))
    d = bars.withColumn("__k", F.dense_rank().over(last)).filter(F.col("__k") <= sessions)
    o = Window.partitionBy("symbol", "session").orderBy("minute")
    before = F.lag("close").over(o)
    d = d.withColumn("r", F.when((F.col("close") > 0) & (before > 0), F.ln(F.when(before > 0, F.col("close") / F.when(before > 0, before)))))
    n = F.count("r")
    vwap = F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume"))
    early = (F.col("minute") < 600)
    mean = lambda a, b: F.avg(F.when((F.col("minute") >= a) & (F.col("minute") < b), F.col("close")))
    lv = F.when(F.col("volume") > 0, F.ln(F.when(F.col("volume") > 0, F.col("volume"))))
    flat = (F.coalesce(F.var_pop(lv), F.lit(0.0)) < 1e-12)
    return d.groupBy("symbol").agg(
        F.sqrt(F.sum(F.col("r") * F.col("r")) * 98280 / F.when(n > 0, n)).alias("realized_vol"),
        (F.max_by("close", F.struct("session", "minute")) / vwap - 1).alias("vwap_premium"),
        ((F.max(F.when(early, F.col("high"))) - F.min(F.when(early, F.col("low")))) / F.min_by("open", F.struct("session", "minute"))).alias("opening_range"),
        (F.ln(mean(930, 960)) - F.ln(mean(810, 870))).alias("afternoon_drift"),
        F.when(flat, F.lit(0.0)).otherwise(F.covar_pop(F.col("minute").cast("double"), lv) / F.sqrt(F.when(~flat, F.var_pop(lv)) * F.var_pop(F.when(lv.isNotNull(), F.col("minute").cast("double"))))).alias("volume_slope"),
    )


def contrarian(z):
    """-1 above 2, 1 below -2, else 0; a null is 0."""
    return F.when(z > 2, -1).when(z < -2, 1).otherwise(0)


def topology_z(df: DataFrame, keys: list[str], time: str, value: str, lookback: int = 20) -> DataFrame:
    """z of a persistence norm against the `lookback` rows before it (population deviation); null before there are as many or where they are flat."""
    f = Window.partitionBy(*keys).orderBy(time).rowsBetween(-lookback, -1)
    sd = F.stddev_pop(value).over(f)
    return df.withColumn("z", F.when((F.count(value).over(f) >= lookback) & (sd > 0), (F.col(value) - F.avg(value).over(f)) / F.when(sd > 0, sd)))


def surprise_events(df: DataFrame, z: str, threshold: float = 1.5) -> DataFrame:
    """The rows whose surprise is beyond threshold either way, with its sign."""
    return df.filter(F.abs(z) > threshold).withColumn("sign", F.signum(z).cast("int"))


def tone_features(news: DataFrame, keys: list[str]) -> DataFrame:
    """ts_nanos, series, feature, value: tone_z and news_volume_z (30 rows before), tone_momentum (less the mean of 7 rows before).

    news: keys, ts_nanos, avg_tone, num_events.  Undefined values are left out.
    """
    from tidewater.operators.rolling import causal_z

    week = Window.partitionBy(*keys).orderBy("ts_nanos").rowsBetween(-7, -1)
    d = news.withColumns({
        "tone_z": causal_z("avg_tone", keys, "ts_nanos", 30),
        "tone_momentum": F.when(F.count(F.lit(1)).over(week) == 7, F.col("avg_tone") - F.avg("avg_tone").over(week)),
        "news_volume_z": causal_z("num_events", keys, "ts_nanos", 30),
    })
    return d.unpivot([*keys, "ts_nanos"], ["tone_z", "tone_momentum", "news_volume_z"], "feature", "value").filter("value IS NOT NULL")
