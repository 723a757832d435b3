"""Joins over time: alignment, forward fill with a budget, as-of, nearest, pairs, membership.

Range conditions are never left to a nested loop over the data: as-of and
forward fill are unions with one window per key, nearest and pair joins are
equi-joins first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, grid: DataFrame, key: str, time: str, value: str, budget: int | None = None) -> DataFrame:
    """(time, key, value) of every key at every time of grid, the last value carried at most `budget` grid steps.

    grid: distinct times.  Every key has every time from its first value on, so grid x keys is the size of the result.
    """
    cells = grid.crossJoin(df.select(key).distinct())
    at = cells.join(df.select(time, key, value), [time, key], "left")
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(time)))
    out = out.withColumns({"__v": F.last(value, ignorenulls=True).over(w), "__at": F.last(F.when(F.col(value).isNotNull(), F.col("__n")), ignorenulls=True).over(w)})
    if budget is not None:
        out = out.filter(F.col("__n") - F.col("__at") <= budget)
    return out.filter(F.col("__v").isNotNull()).select(time, key, F.col("__v").alias(value))


def align(df: DataFrame, key: str, time: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One row for each time that every key has, one column for each key (inner equi-join of all series).

    One shuffle on the time, whatever the number of series.  Without names, they are read from the data.
    """
    names = names or [r[0] for r in df.select(key).distinct().orderBy(key).collect()]  # a column each, so few
    wide = df.groupBy(time).pivot(key, names).agg(F.first(value, ignorenulls=True))
    return wide.na.drop(subset=names)


def aligned_long(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows of the times that every key has; the number of keys is one broadcast value."""
    d = df.groupBy(time, key).agg(F.first(value, ignorenulls=True).alias(value))
    n = d.agg(F.countDistinct(key).alias("__keys"))
    w = Window.partitionBy(time)
    return d.withColumn("__have", F.count(value).over(w)).join(F.broadcast(n), F.col("__have") == F.col("__keys")).select(time, key, value)


def pairs(df: DataFrame, key: str, time: str, value: str, ordered: bool = False) -> DataFrame:
    """time, a, b, x, y for all pairs of keys at one time: a < b, or both orders; an equi-join on the time."""
    l = df.select(F.col(time), F.col(key).alias("a"), F.col(value).alias("x"))
    r = df.select(F.col(time), F.col(key).alias("b"), F.col(value).alias("y"))
    return l.join(r, time).filter(F.col("a") != F.col("b") if ordered else F.col("a") < F.col("b"))


def asof(left: DataFrame, right: DataFrame, time: str, keys: list[str], columns: list[str], exclusive: bool = False) -> DataFrame:
    """left with the columns of the last right row at or before its time (before it, if exclusive).

    A union and one running window for each key: linear, no range join.
    """
    names = [c for c in left.columns if c not in keys and c != time]
    # right rows sort before left rows of the same time, or after them if exclusive
    l = left.select(*keys, time, F.lit(1).alias("__side"), F.struct(*names, F.lit(1).alias("__one")).alias("__l"), F.lit(None).cast(right.select(F.struct(time, *columns)).schema[0].dataType).alias("__r"))
    r = right.select(*keys, time, F.lit(2 if exclusive else 0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(time, *columns).alias("__r"))
    w = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter(F.col("__l").isNotNull())
    return out.select(*keys, time, *(F.col(f"__l.{c}").alias(c) for c in names), F.col(f"__r.{time}").alias(f"{time}_asof"), *(F.col(f"__r.{c}").alias(c) for c in columns))


def nearest(df: DataFrame, keys: list[str], distance: Column, order: Column, value: str) -> DataFrame:
    """For each key the value of the row with the smallest distance, the first in order on ties."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(distance, order)).alias(value))


def lagged_pairs(p: DataFrame, horizon: int, time: str = "ts_nanos") -> DataFrame:
    """x at t beside y at t + horizon rows, for each pair."""
    w = Window.partitionBy("a", "b").orderBy(time)
    return p.withColumn("y_ahead", F.lead("y", horizon).over(w)).filter(F.col("y_ahead").isNotNull())


def membership(desired: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """key, target, held, delta for the union of both sides."""
    j = desired.join(held, key, "full_outer")
    return j.select(key, F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("qty", F.lit(0.0)).alias("held")).withColumn("delta", F.col("target") - F.col("held"))


def regime_join(equity: DataFrame, regimes: DataFrame, time: str = "ts_nanos") -> DataFrame:
    """equity with the regime of its time: the last one written wins, 'unknown' where there is none."""
    last = regimes.groupBy(time).agg(F.max_by("regime", "seq").alias("regime"))
    return equity.join(last, time, "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))
