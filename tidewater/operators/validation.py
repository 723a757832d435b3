"""Bar validation: filters, duplicates, order, gaps, outliers, splits, and the list of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.rolling import log_return

SYMBOL = "^[A-Z0-9.-]{1,12}$"


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(F.regexp_like(symbol, F.lit(SYMBOL)), F.lit(False))


def positive() -> Column:
    return (F.least("open", "high", "low", "close") > 0) & (F.col("volume") >= 0)


def sane() -> Column:
    return F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))


def first_of_each(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row by position for each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).filter("__n = 1").drop("__n")


def clean(bars: DataFrame, position: str) -> DataFrame:
    """Rows that pass both filters, the first for each (symbol, ts_nanos)."""
    return first_of_each(bars.filter(positive() & sane()), ["symbol", "ts_nanos"], position)


def gaps(bars: DataFrame, threshold: float = 5.0) -> DataFrame:
    """symbol, ts_nanos, step: steps above threshold times the symbol's median step; three rows at least."""
    order = Window.partitionBy("symbol").orderBy("ts_nanos")
    steps = bars.withColumn("step", F.col("ts_nanos") - F.lag("ts_nanos").over(order)).filter("step IS NOT NULL")
    medians = steps.groupBy("symbol").agg(F.median("step").alias("usual"), F.count(F.lit(1)).alias("n"))
    # one row for each symbol
    return steps.join(medians, "symbol").filter((F.col("n") >= 2) & (F.col("usual") > 0) & (F.col("step") > F.col("usual") * threshold)).select("symbol", "ts_nanos", "step")


def outliers(bars: DataFrame, n: int = 30, least: int = 15, limit: float = 5.0) -> DataFrame:
    """symbol, ts_nanos, z: log returns against the n before, population deviation."""
    order = Window.partitionBy("symbol").orderBy("ts_nanos")
    d = bars.select("symbol", "ts_nanos", log_return(F.col("close"), order).alias("r"))
    f = order.rowsBetween(-n, -1)
    sd = F.stddev_pop("r").over(f)
    z = F.when((F.count("r").over(f) >= least) & (sd > 0), (F.col("r") - F.avg("r").over(f)) / F.when(sd > 0, sd))
    return d.withColumn("z", z).filter(F.abs("z") > limit).select("symbol", "ts_nanos", "z")


def splits(bars: DataFrame, ratio: float = 1.5) -> DataFrame:
    """symbol, ts_nanos, ratio: closes that jump by more than ratio either way."""
    order = Window.partitionBy("symbol").orderBy("ts_nanos")
    q = F.try_divide("close", F.lag("close").over(order))
    return bars.select("symbol", "ts_nanos", F.greatest(q, F.try_divide(F.lit(1.0), q)).alias("ratio")).filter(F.col("ratio") > ratio)


def backward(kept: DataFrame, file: str, position: str) -> DataFrame:
    """Rows whose time isn't after that of the row before in their file, whatever its symbol; kept: rows without drops and repeats."""
    before = F.lag("ts_nanos").over(Window.partitionBy(file).orderBy(position))
    return kept.withColumn("__before", before).filter(F.col("ts_nanos") <= F.col("__before")).drop("__before")


def file_report(bars: DataFrame, file: str, position: str) -> DataFrame:
    """file, rows, kept_rows, dropped_rows, duplicate_rows, non_positive, ohlc_violation, non_monotonic, needs_cleaning; one row a file.

    Repeats are those of (symbol, time) within a file; order is counted over the rows kept.
    """
    good = positive() & sane()
    kept = first_of_each(bars.filter(good), [file, "symbol", "ts_nanos"], position)
    one = F.count(F.lit(1))
    all_rows = bars.groupBy(file).agg(one.alias("rows"), F.count_if(~positive()).alias("non_positive"), F.count_if(positive() & ~sane()).alias("ohlc_violation"), F.count_if(good).alias("__good"))
    kept_rows = kept.groupBy(file).agg(one.alias("kept_rows"))
    back = backward(kept, file, position).groupBy(file).agg(one.alias("non_monotonic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = all_rows.join(kept_rows, file, "left").join(back, file, "left").withColumns({"kept_rows": zero("kept_rows"), "non_monotonic": zero("non_monotonic")})
    out = out.withColumns({"dropped_rows": F.col("rows") - F.col("kept_rows"), "duplicate_rows": F.col("__good") - F.col("kept_rows")})
    return out.select(file, "rows", "kept_rows", "dropped_rows", "duplicate_rows", "non_positive", "ohlc_violation", "non_monotonic", ((F.col("dropped_rows") > 0) | (F.col("non_monotonic") > 0)).alias("needs_cleaning"))


def cleaned(bars: DataFrame, file: str, position: str) -> DataFrame:
    """The rows kept of the files that need cleaning, to be written beside them; `place` is a row's number by time in its file."""
    dirty = file_report(bars, file, position).filter("needs_cleaning").select(file)
    kept = first_of_each(bars.filter(positive() & sane()), [file, "symbol", "ts_nanos"], position).join(dirty, file, "left_semi")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(file).orderBy("ts_nanos", position)).cast("long"))


def write_cleaned(bars: DataFrame, file: str, position: str, path: str) -> None:
    """cleaned() as CSV, a folder for each file, by time."""
    cleaned(bars, file, position).repartition(file).sortWithinPartitions(file, "place").drop(position, "place").write.partitionBy(file).option("header", True).csv(path)


def issues(bars: DataFrame, position: str, file: str = "symbol") -> DataFrame:
    """type, n, first: one row for each kind of issue that occurs; steps back in time are counted in file order over the rows kept."""
    per_row = bars.select(
        "ts_nanos",
        F.explode(
            F.filter(
                F.array(
                    F.when(~valid_symbol(F.col("symbol")), F.lit("bad_symbol")),
                    F.when(~positive(), F.lit("non_positive")),
                    F.when(positive() & ~sane(), F.lit("ohlc")),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("type"),
    )
    good = bars.filter(positive() & sane())
    repeats = good.groupBy("symbol", "ts_nanos").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")
    kept = clean(bars, position)
    parts = [
        per_row.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("ts_nanos").alias("first")),
        repeats.agg(F.sum("n").alias("n"), F.min("ts_nanos").alias("first")).select(F.lit("duplicate").alias("type"), "n", "first").filter("n > 0"),
    ]
    for name, found in (("non_monotonic", backward(kept, file, position)), ("gap", gaps(kept)), ("outlier", outliers(kept)), ("split", splits(kept))):
        parts.append(found.agg(F.count(F.lit(1)).alias("n"), F.min("ts_nanos").alias("first")).select(F.lit(name).alias("type"), "n", "first").filter("n > 0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def long_universe(symbols: DataFrame, adv: DataFrame, least: float) -> DataFrame:
    """Members whose average volume is at least `least` or unknown."""
    return symbols.join(adv, "symbol", "left").filter(F.coalesce("adv", F.lit(float("inf"))) >= least).select("symbol")


def short_universe(symbols: DataFrame, adv: DataFrame, hard: DataFrame, least: float) -> DataFrame:
    """The long universe without what is hard to borrow."""
    return long_universe(symbols, adv, least).join(hard, "symbol", "left_anti")
