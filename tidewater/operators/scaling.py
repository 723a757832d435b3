"""Scaling exponents from segments of many lengths, and concordance of distances, without a matrix or a loop over a series.

A row is copied once for each scale and told its segment; segments are small groups
of one aggregation, so a long series is dealt over the cluster by (scale, segment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("a", "b")
RATIO = 1.5
QS = (-5, -3, -2, -1, 0, 1, 2, 3, 5)


def sizes(most: int = 1 << 40) -> list[int]:
    """8, 12, 18, ...: each half as long again, rounded up."""
    out = [8]
    while out[-1] < most:
        out.append(-int(-out[-1] * RATIO // 1))
    return out


def numbered(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, i (from 0), n, x."""
    w = Window.partitionBy(*keys)
    return df.select(*keys, (F.row_number().over(w.orderBy(time)).cast("long") - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"), F.col(value).cast("double").alias("x"))


def rescaled_range(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, hurst: slope of ln R/S on ln size over sizes 8, 12, 18, ... up to half the rows, clipped to 0 .. 1; null below 32 rows or 4 sizes."""
    rows = numbered(df, keys, time, value)
    fit = F.filter(F.array(*(F.lit(s).cast("long") for s in sizes())), lambda s: s <= F.floor(F.col("n") / 2))
    tall = rows.filter("n >= 32").select(*keys, "i", "n", "x", F.explode(fit).alias("size")).withColumn("segment", F.expr("i div size")).filter("segment < n div size")
    w = Window.partitionBy(*keys, "size", "segment")
    mean = F.avg("x").over(w)
    walk = F.sum("x").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("i") % F.col("size") + 1) * F.col("mean")
    tall = tall.withColumn("mean", mean).withColumn("walk", walk)
    parts = tall.groupBy(*keys, "size", "segment").agg((F.max("walk") - F.min("walk")).alias("range"), F.stddev_pop("x").alias("sd"))
    by_size = parts.filter("sd > 0").groupBy(*keys, "size").agg(F.avg(F.col("range") / F.col("sd")).alias("rs")).filter("rs > 0")
    fits = by_size.groupBy(*keys).agg(F.count(F.lit(1)).alias("sizes"), F.regr_slope(F.ln("rs"), F.ln("size")).alias("slope"))
    hurst = F.when(F.col("sizes") >= 4, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "slope")))
    return df.select(*keys).distinct().join(fits, keys, "left").select(*keys, hurst.alias("hurst"))


def fluctuations(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, q, h: generalised Hurst exponents: slopes of the q-th mean of the fluctuations on the scale.

    Fluctuations are the variances of the walk around its line in segments of ten
    scales from 10 to a quarter of the rows, dealt from both ends of the series.
    """
    rows = numbered(df, keys, time, value)
    w = Window.partitionBy(*keys)
    walk = F.sum(F.col("x") - F.col("mean")).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("mean", F.avg("x").over(w)).withColumn("walk", walk)
    top = F.greatest(F.lit(11).cast("long"), F.expr("n div 4"))
    steps = [F.lit(10).cast("long"), *(F.floor(10 * F.pow(top / 10, F.lit(k / 9))).cast("long") for k in range(1, 9)), top]
    tall = rows.select(*keys, "i", "n", "walk", F.explode(F.array_distinct(F.array(*steps))).alias("scale")).withColumn("segments", F.expr("n div scale"))
    first, second = F.expr("i div scale"), F.expr("(i - (n - segments * scale)) div scale")
    ends = F.array(F.struct(F.lit(0).alias("end"), first.alias("segment"), (first < F.col("segments")).alias("ok")), F.struct(F.lit(1).alias("end"), second.alias("segment"), (F.col("i") >= F.col("n") - F.col("segments") * F.col("scale")).alias("ok")))
    tall = tall.select(*keys, "scale", "i", "walk", F.explode(ends).alias("s")).filter("s.ok")
    t = F.col("i").cast("double")
    line = F.covar_pop(t, "walk")
    var = F.var_pop("walk") - line * line / F.var_pop(t)
    parts = tall.groupBy(*keys, "scale", "s.end", "s.segment").agg(F.greatest(var, F.lit(1e-300)).alias("var"))
    each = F.explode(F.array(*(F.lit(q) for q in QS))).alias("q")
    parts = parts.select(*keys, "scale", "var", each)
    power = F.avg(F.when(F.col("q") != 0, F.pow("var", F.col("q") / 2)))
    f = F.when(F.first("q") == 0, 0.5 * F.avg(F.ln("var"))).otherwise(F.ln(power) / F.when(F.first("q") != 0, F.first("q")))
    by_scale = parts.groupBy(*keys, "scale", "q").agg(f.alias("f"))
    return by_scale.groupBy(*keys, "q").agg(F.regr_slope("f", F.ln("scale")).alias("h"))


def spectrum(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, h2, width: the exponent of q = 2 and the range of the singularity strengths d(q h - 1) / dq."""
    h = fluctuations(df, keys, time, value).withColumn("tau", F.col("q") * F.col("h") - 1)
    w = Window.partitionBy(*keys).orderBy("q")
    low, high, before, after = F.lag("q").over(w), F.lead("q").over(w), F.lag("tau").over(w), F.lead("tau").over(w)
    a, b = F.col("q") - low, high - F.col("q")
    middle = (a * a * after + (b * b - a * a) * F.col("tau") - b * b * before) / (a * b * (a + b))
    alpha = F.when(low.isNull(), (after - F.col("tau")) / b).when(high.isNull(), (F.col("tau") - before) / a).otherwise(middle)
    h = h.withColumn("alpha", alpha)
    return h.groupBy(*keys).agg(F.max(F.when(F.col("q") == 2, F.col("h"))).alias("h2"), (F.max("alpha") - F.min("alpha")).alias("width"))


def distance_correlation(pairs: DataFrame, bits: int = 40) -> DataFrame:
    """a, b, dcor: distance correlation of x and y; 0 below four rows or where either is flat.

    The sum of |x - x'| |y - y'| over all pairs of rows is met as a merge sort by x
    meets them: at each level, rows of a block's right half see the sums of 1, x, y and
    x y over those of its left half that y orders before them.  So the cost is n log n,
    in windows by (pair, level, block).  `bits` bounds the length of a series (2^bits rows).
    """
    w = Window.partitionBy(*PAIR)
    p = pairs.select(*PAIR, (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    p = p.withColumns({"i": F.row_number().over(w.orderBy("x", "y")).cast("long") - 1, "n": F.count(F.lit(1)).over(w)})

    def distances(v: str) -> Column:
        upto = w.orderBy(v)  # with equal ones, whose distance is 0
        c, s = F.count(F.lit(1)).over(upto), F.sum(v).over(upto)
        return F.col(v) * (2 * c - F.col("n")) + F.sum(v).over(w) - 2 * s

    p = p.withColumns({"dx": distances("x"), "dy": distances("y")})
    levels = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: F.pow(F.lit(2.0), k) < F.col("n"))
    t = p.select(*PAIR, "x", "y", "i", F.explode(levels).alias("level"))
    t = t.select(*PAIR, "x", "y", "level", F.expr("shiftright(i, level + 1)").alias("block"), (F.expr("shiftright(i, level)") % 2).alias("right"))
    block = Window.partitionBy(*PAIR, "level", "block")
    left = 1 - F.col("right")
    sums = {"c": left, "sx": left * F.col("x"), "sy": left * F.col("y"), "sxy": left * F.col("x") * F.col("y")}
    t = t.withColumns({k: 2 * F.sum(v).over(block.orderBy("y")) - F.sum(v).over(block) for k, v in sums.items()})
    met = F.col("c") * F.col("x") * F.col("y") - F.col("x") * F.col("sy") - F.col("y") * F.col("sx") + F.col("sxy")
    products = t.filter("right = 1").groupBy(*PAIR).agg((2 * F.sum(met)).alias("d"))
    g = p.groupBy(*PAIR).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(F.col(u) * F.col(v)).alias(u + v) for u, v in (("dx", "dy"), ("dx", "dx"), ("dy", "dy"), ("x", "x"), ("y", "y"))), F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    g = g.join(products, list(PAIR), "left")
    n = F.col("n")

    def covariance(total: Column, rows: str, one: str, two: str) -> Column:
        return total / n**2 - 2 * F.col(rows) / n**3 + F.col(one) * F.col(two) / n**4

    both = covariance(F.coalesce("d", F.lit(0.0)), "dxdy", "dx", "dy")
    own = covariance(2 * n * F.col("xx"), "dxdx", "dx", "dx") * covariance(2 * n * F.col("yy"), "dydy", "dy", "dy")
    ok = (n >= 4) & (F.col("xx") > 0) & (F.col("yy") > 0) & (own > 0)
    return g.select(*PAIR, F.when(ok, F.sqrt(F.greatest(F.lit(0.0), both) / F.sqrt(F.when(ok, own)))).otherwise(F.lit(0.0)).alias("dcor"))
