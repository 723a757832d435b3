"""Regressions on lags from their normal equations: Gram sums in one aggregation, elimination as an array expression.

A row carries its regressors and its response as an array z, the response last.
The sums of z_i z_j over a group, after the means are taken out, are all that a
regression needs; they are combined before the shuffle.  Eliminating a regressor
leaves the matrix of what it doesn't explain, so the last cell is the residual sum
of squares after each step: nested models cost one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.special import f_upper
from tidewater.operators.scans import once


def gram(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, gram: the centred products of the columns, array<array<double>>.

    Moments are taken about each group's own mean by Spark's covariances, which merge
    without cancelling.
    """
    def cell(a: str, b: str) -> Column:
        return F.covar_pop(a, b) * F.count(a)

    upper = {(i, j): f"__g{i}_{j}" for i in range(len(columns)) for j in range(i, len(columns))}
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(cell(columns[i], columns[j]).alias(c) for (i, j), c in upper.items()))
    rows = [F.array(*(F.col(upper[min(i, j), max(i, j)]) for j in range(len(columns)))) for i in range(len(columns))]
    return sums.select(*keys, "n", F.array(*rows).alias("gram"))


def eliminate(m: Column) -> Column:
    """The matrix without its first variable and what that explains; a variable that earlier ones explain leaves it as it is."""
    def rest(m: Column) -> Column:
        head = F.get(m, F.lit(0))
        pivot = F.get(head, F.lit(0))
        tail = F.slice(head, 2, F.size(head) - 1)
        return F.transform(F.slice(m, 2, F.size(m) - 1), lambda row: F.zip_with(F.slice(row, 2, F.size(row) - 1), tail, lambda x, t: F.when(pivot > 1e-12, x - F.get(row, F.lit(0)) * t / F.when(pivot > 1e-12, pivot)).otherwise(x)))

    return once(m, rest)


def last_cell(m: Column) -> Column:
    return F.element_at(F.element_at(m, -1), -1)


def lagged(df: DataFrame, keys: list[str], time: str, column: str, lags: int, name: str) -> DataFrame:
    """df with name1 .. nameN, the column so many rows of the keys before."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumns({f"{name}{k}": F.lag(column, k).over(w) for k in range(1, lags + 1)})


def granger(pairs: DataFrame, keys: list[str], time: str, x: str, y: str, lags: int = 2) -> DataFrame:
    """keys, f, p: whether x's lags help to predict y beside y's own; 0 and 1 below 3 lags + 2 rows, or with nothing left to explain."""
    both = lagged(lagged(pairs, keys, time, y, lags, "__y"), keys, time, x, lags, "__x")
    full = both.filter(F.col(f"__y{lags}").isNotNull() & F.col(f"__x{lags}").isNotNull())
    own, more = [f"__y{k}" for k in range(1, lags + 1)], [f"__x{k}" for k in range(1, lags + 1)]
    g = gram(full, keys, [*own, *more, y])
    g = pairs.select(*keys).distinct().join(g, keys, "left")  # groups too short for any row
    m = F.col("gram")
    for _ in range(lags):
        m = eliminate(m)
    g = g.withColumn("__own", m)
    m = F.col("__own")
    for _ in range(lags):
        m = eliminate(m)
    free = F.col("n") - 2 * lags - 1
    g = g.withColumns({"__s0": last_cell(F.col("__own")), "__s1": last_cell(m)})
    usable = (F.col("n") > 3 * lags + 1) & (F.col("__s1") > 0) & (free > 0)
    f = F.when(usable, F.greatest(F.lit(0.0), (F.col("__s0") - F.col("__s1")) / lags / (F.when(usable, F.col("__s1")) / F.when(usable, free)))).otherwise(F.lit(0.0))
    return g.withColumn("f", f).select(*keys, "f", F.when(usable, f_upper(F.col("f"), F.lit(lags), free)).otherwise(F.lit(1.0)).alias("p"))


def dickey_fuller(df: DataFrame, keys: list[str], time: str, value: str, lags: int = 1) -> DataFrame:
    """keys, n, t of the level in the augmented regression of the change, with intercept; 0 below 2 lags + 5 changes."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = df.select(*keys, time, F.lag(value).over(w).alias("__level"), (F.col(value) - F.lag(value).over(w)).alias("__d"))
    full = lagged(d, keys, time, "__d", lags, "__d").filter(F.col(f"__d{lags}").isNotNull())
    g = gram(full, keys, [*(f"__d{k}" for k in range(1, lags + 1)), "__level", "__d"])
    g = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("__changes")).join(g, keys, "left")
    m = F.col("gram")
    for _ in range(lags):
        m = eliminate(m)
    g = g.withColumn("__m", m)
    level, cross, own = (F.element_at(F.element_at("__m", i), j) for i, j in ((1, 1), (1, 2), (2, 2)))
    rest = own - cross * cross / F.when(level > 1e-12, level)
    free = F.col("n") - lags - 2
    se = F.sqrt(F.when(rest > 0, rest) / F.when(free > 0, free) / F.when(level > 1e-12, level))
    t = F.when((F.col("__changes") > 2 * lags + 4) & (se > 0), cross / level / se)
    return g.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(t, F.lit(0.0)).alias("t"))
