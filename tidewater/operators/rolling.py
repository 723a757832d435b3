"""Rolling and cross-sectional features over long series; every frame ends at the current row or before it.

All features of a series share one partitioning and order, so a plan has one
exchange and one sort for any number of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WINDOWS = (5, 21, 63, 252)


def frame(keys: list[str], time: str, low: int, high: int = 0) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time).rowsBetween(low, high)


def log_return(v: Column, w: WindowSpec) -> Column:
    """ln(v / previous) where both are positive, else null."""
    before = F.lag(v).over(w)
    return F.when((v > 0) & (before > 0), F.ln(F.when(v > 0, v) / F.when(before > 0, before)))


def extract_features(df: DataFrame, key: str = "series", time: str = "ts_nanos", value: str = "value", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """ts_nanos, series, feature, value: level, log, diff, log_return, drawdown, and seven features a window.

    A window is used where the series has more rows than it.  Undefined values
    are dropped; skew and kurtosis (population, excess) of a flat window are 0;
    a missing return counts as 0 in the realised volatility.
    """
    order = Window.partitionBy(key).orderBy(time)
    whole = Window.partitionBy(key)
    v = F.col("v")
    d = df.select(F.col(key).alias("series"), F.col(time).alias("ts_nanos"), F.col(value).alias("v"))
    order, whole = Window.partitionBy("series").orderBy("ts_nanos"), Window.partitionBy("series")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"n": F.row_number().over(order), "total": F.count(F.lit(1)).over(whole), "before": F.lag("v").over(order), "peak": F.max("v").over(running), "r": log_return(v, order)})
    d = d.withColumn("r0", F.coalesce("r", F.lit(0.0)))
    out = {
        "level": v,
        "log": F.when(v > 0, F.ln(F.when(v > 0, v))),
        "diff": v - F.col("before"),
        "log_return": F.col("r"),
        "drawdown": F.when(F.col("peak") > 0, (v - F.col("peak")) / F.when(F.col("peak") > 0, F.col("peak"))),
    }
    columns = {}
    for w in windows:
        f = order.rowsBetween(1 - w, 0)
        full = (F.col("total") > w) & (F.col("n") >= w)
        sd = F.stddev_pop("v").over(f)
        back = F.lag("v", w).over(order)
        columns |= {
            f"ma_{w}": F.when(full, F.avg("v").over(f)),
            f"std_{w}": F.when(full, sd),
            f"momentum_{w}": F.when((F.col("total") > w) & (v > 0) & (back > 0), F.ln(F.when((v > 0) & (back > 0), v / F.when(back > 0, back)))),
            f"rv_ann_{w}": F.when(full, F.stddev_pop("r0").over(f) * F.sqrt(F.lit(252.0))),
            f"skew_{w}": F.when(full, F.coalesce(F.when(sd > 0, F.skewness("v").over(f)), F.lit(0.0))),
            f"kurt_{w}": F.when(full, F.coalesce(F.when(sd > 0, F.kurtosis("v").over(f)), F.lit(0.0))),
        }
    d = d.withColumns(columns)
    for w in windows:
        out |= {c: F.col(c) for c in columns if c.endswith(f"_{w}")}
        out[f"zscore_{w}"] = F.when(F.col(f"std_{w}") > 0, (v - F.col(f"ma_{w}")) / F.when(F.col(f"std_{w}") > 0, F.col(f"std_{w}")))
    tall = d.select("ts_nanos", "series", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), c.cast("double").alias("value")) for k, c in out.items()))).alias("f"))
    return tall.select("ts_nanos", "series", "f.feature", "f.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def panel_returns(df: DataFrame, key: str = "series", time: str = "ts_nanos", value: str = "value") -> DataFrame:
    """Log differences where the whole series is positive, else plain ones; not finite counts as 0; first rows dropped."""
    w = Window.partitionBy(key).orderBy(time)
    low = F.min(value).over(Window.partitionBy(key))
    v, before = F.col(value), F.lag(value).over(w)
    r = F.when(low > 0, F.ln(F.when(low > 0, v / F.when(low > 0, before)))).otherwise(v - before)
    return df.withColumns({"__before": before, "ret": F.coalesce(r, F.lit(0.0))}).filter(F.col("__before").isNotNull()).select(time, key, "ret")


def cross_z(value: str, time: str = "ts_nanos") -> Column:
    """Z score within one time, sample deviation; null below two values, 0 where they are all alike."""
    w = Window.partitionBy(time)
    n, sd = F.count(value).over(w), F.stddev_samp(value).over(w)
    return F.when(n < 2, F.lit(None).cast("double")).when(sd > 0, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd)).otherwise(F.lit(0.0))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1, ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def ordinal_rank(value: str, keys: list[str], tie: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)).cast("long")


def empirical_cdf(value: str, keys: list[str]) -> Column:
    return average_rank(value, keys) / (F.count(F.lit(1)).over(Window.partitionBy(*keys)) + 1)


def quantile_bin(value: str, keys: list[str], tie: str, bins: int) -> Column:
    """min(bins - 1, rank * bins div n), rank from 0; ntile differs where bins don't divide n."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.least(F.lit(bins - 1).cast("long"), F.floor(rank * bins / n))


def causal_z(value: str, keys: list[str], time: str, n: int, population: bool = False, least: int | None = None) -> Column:
    """Z score against the n rows before the current one; null before there are `least` of them or where they are flat."""
    f = frame(keys, time, -n, -1)
    sd = (F.stddev_pop if population else F.stddev_samp)(value).over(f)
    return F.when((F.count(value).over(f) >= (least or n)) & (sd > 1e-12), (F.col(value) - F.avg(value).over(f)) / F.when(sd > 1e-12, sd))


def log_change(value: str, keys: list[str], time: str) -> Column:
    """ln(v / previous); 0 where either isn't positive, null on the first row."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    ok = (F.col(value) > 0) & (before > 0)
    return F.when(before.isNull(), F.lit(None).cast("double")).when(ok, F.ln(F.when(ok, F.col(value) / F.when(before > 0, before)))).otherwise(F.lit(0.0))


def regime_coordinate(returns: DataFrame, n: int = 60, time: str = "ts_nanos", value: str = "ret") -> DataFrame:
    """ts_nanos, coordinate: trailing sample deviation of the equal-weight mean of all series.

    The mean leaves one row for each time, which the one-partition window then runs over.
    """
    m = returns.groupBy(time).agg(F.avg(value).alias("m"))
    f = Window.orderBy(time).rowsBetween(1 - n, 0)
    return m.withColumn("coordinate", F.when(F.count("m").over(f) >= n, F.stddev_samp("m").over(f))).select(time, "coordinate")


def regime_bucket(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """df with bucket 0 .. buckets - 1 between interpolated quantiles, -1 for a null."""
    edges = df.agg(F.percentile(value, F.lit([k / buckets for k in range(1, buckets)])).alias("__edges"))
    inside = F.aggregate("__edges", F.lit(0).cast("long"), lambda a, e: a + F.when(F.col(value) >= e, 1).otherwise(0))
    return df.join(F.broadcast(edges)).withColumn("bucket", F.when(F.col(value).isNull(), F.lit(-1).cast("long")).otherwise(inside)).drop("__edges")


def rolling_windows(n_rows: int, size: int, step: int) -> list[tuple[int, int]]:
    """[start, end) of windows ending at size, size + step, ..., and at the last row."""
    ends = list(range(size, n_rows + 1, step))
    if n_rows >= size and (not ends or ends[-1] != n_rows):
        ends.append(n_rows)
    return [(e - size, e) for e in ends]


def explode_windows(df: DataFrame, key: str, time: str, size: int, step: int) -> DataFrame:
    """Each row once for each window it lies in, with window_end (a row count); row-local after numbering."""
    w = Window.partitionBy(key)
    n = df.withColumns({"__i": F.row_number().over(w.orderBy(time)).cast("long"), "__n": F.count(F.lit(1)).over(w)})
    first = F.greatest(F.lit(size).cast("long"), F.lit(size) + F.ceil((F.col("__i") - size) / step) * step)
    last = F.least(F.col("__i") + size - 1, F.lit(size) + F.floor((F.col("__n") - size) / step) * step)
    ends = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.lit(step).cast("long"))).otherwise(F.lit([]).cast("array<long>"))
    tail = F.when((F.pmod(F.col("__n") - size, F.lit(step)) != 0) & (F.col("__i") > F.col("__n") - size), F.array("__n")).otherwise(F.lit([]).cast("array<long>"))
    return n.filter(F.col("__n") >= size).withColumn("window_end", F.explode(F.concat(ends, tail))).drop("__i", "__n")


def top_bottom(score: str, k: int, time: str = "ts_nanos", tie: str = "symbol") -> Column:
    """1 for the k largest of a time, -1 for the k smallest, else 0; ties by symbol."""
    up = F.row_number().over(Window.partitionBy(time).orderBy(F.desc(score), tie))
    down = F.row_number().over(Window.partitionBy(time).orderBy(F.asc(score), F.desc(tie)))
    return F.when(up <= k, 1).when(down <= k, -1).otherwise(0)


def momentum_scores(filled: DataFrame, n: int = 20, least: int = 4) -> DataFrame:
    """ts_nanos, symbol, score, z: sum of n log returns over their volatility, and its cross-sectional z."""
    order = Window.partitionBy("symbol").orderBy("ts_nanos")
    f = order.rowsBetween(1 - n, 0)
    d = filled.withColumn("r", log_return(F.col("close"), order))
    sd = F.stddev_samp("r").over(f)
    d = d.withColumn("score", F.when((F.count("r").over(f) >= n) & (sd > 0), F.sum("r").over(f) / F.when(sd > 0, sd))).filter(F.col("score").isNotNull())
    d = d.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy("ts_nanos")), "z": cross_z("score")})
    return d.filter(F.col("__n") >= least).select("ts_nanos", "symbol", "score", "z")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
