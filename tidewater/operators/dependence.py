"""Dependence between series: correlations, concordance, information, transfer entropy, tails, sign tests, cointegration.

Input is the pair table (a, b, ts_nanos, x, y): every estimator is one
aggregation over it, so pairs spread over the cluster and no panel is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("a", "b")


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson from moments; 0 for a constant side, within [-1, 1]."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    cov = F.sum(x * y) - sx * sy / n
    vx, vy = F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n
    ok = (vx > 1e-12) & (vy > 1e-12)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(F.when(ok, vx * vy))))).otherwise(F.lit(0.0))


def pearson(pairs: DataFrame) -> DataFrame:
    c = pairs.groupBy(*PAIR).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    centred = pairs.join(c, list(PAIR)).select(*PAIR, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    return centred.groupBy(*PAIR).agg(guarded_corr(F.col("x"), F.col("y")).alias("rho"))


def with_ranks(pairs: DataFrame) -> DataFrame:
    """x and y replaced by their average ranks within the pair."""
    p = pairs
    for c in ("x", "y"):
        r = F.rank().over(Window.partitionBy(*PAIR).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*PAIR, c)) - 1) / F.lit(2.0)
        p = p.withColumn(f"r{c}", r)
    return p.drop("x", "y").withColumnsRenamed({"rx": "x", "ry": "y"})


def spearman(pairs: DataFrame) -> DataFrame:
    return with_ranks(pairs).groupBy(*PAIR).agg(guarded_corr(F.col("x"), F.col("y")).alias("rho"))


def kendall(pairs: DataFrame, bits: int = 40) -> DataFrame:
    """a, b, tau (joint ties stay in both denominators), tau_a (ties skipped, over all pairs of times).

    Discordant pairs are inversions of y in the order of x, counted as a merge sort
    meets them: at each level, rows of a block's right half count the larger y of its
    left half.  All levels are rows of one running window by (pair, level, block), so
    the cost is n log n and spreads over the cluster.  `bits` bounds the length of a
    series (2^bits rows).
    """
    w = Window.partitionBy(*PAIR)
    p = pairs.withColumns({"i": F.row_number().over(w.orderBy("x", "y")).cast("long") - 1, "n": F.count(F.lit(1)).over(w)})
    levels = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: F.expr("1L") * F.pow(F.lit(2.0), k) < F.col("n"))
    t = p.select(*PAIR, "y", "i", F.explode(levels).alias("level"))
    t = t.select(*PAIR, "y", "level", F.expr("shiftright(i, level + 1)").alias("block"), (F.expr("shiftright(i, level)") % 2).alias("right"))
    block = Window.partitionBy(*PAIR, "level", "block")
    left = F.sum(1 - F.col("right"))
    t = t.withColumns({"all": left.over(block), "below": left.over(block.orderBy("y"))})  # up to and with equal y
    d = t.filter("right = 1").groupBy(*PAIR).agg(F.sum(F.col("all") - F.col("below")).alias("d"))

    def tied(*by: str) -> DataFrame:
        c = F.count(F.lit(1)).cast("double")
        return pairs.groupBy(*PAIR, *by).agg((c * (c - 1) / 2).alias("c")).groupBy(*PAIR).agg(F.sum("c").alias("t" + "".join(by)))

    keys = list(PAIR)
    g = tied().join(tied("x"), keys).join(tied("y"), keys).join(tied("x", "y"), keys).join(d, keys, "left").filter("t > 0")
    n, nx, ny = F.col("t"), F.col("t") - F.col("tx"), F.col("t") - F.col("ty")
    cd = n - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.coalesce("d", F.lit(0))
    ok = (nx > 0) & (ny > 0)
    return g.select(*PAIR, F.when(ok, cd / F.sqrt(F.when(ok, nx * ny))).otherwise(F.lit(0.0)).alias("tau"), (cd / n).alias("tau_a"))


def freedman_diaconis(x: str) -> Column:
    """Number of equal-width bins, at least 1, as an aggregate."""
    iqr = F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))
    width = 2 * iqr / F.cbrt(F.count(x).cast("double"))
    span = F.max(x) - F.min(x)
    return F.when(width > 0, F.greatest(F.lit(1), F.ceil(span / F.when(width > 0, width)).cast("int"))).otherwise(F.lit(1))


def equal_width(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """Bin from 0; the right edge belongs to the last bin."""
    return F.when(high > low, F.least(bins - 1, F.floor((x - low) / F.when(high > low, high - low) * bins).cast("int"))).otherwise(F.lit(0))


def binned(pairs: DataFrame) -> DataFrame:
    """a, b, i, j: equal-width bins of both sides, their number from x alone."""
    s = pairs.groupBy(*PAIR).agg(freedman_diaconis("x").alias("bins"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    p = pairs.join(s, list(PAIR))
    return p.select(*PAIR, equal_width(F.col("x"), F.col("x0"), F.col("x1"), F.col("bins")).alias("i"), equal_width(F.col("y"), F.col("y0"), F.col("y1"), F.col("bins")).alias("j"))


def information(cells: DataFrame) -> DataFrame:
    """a, b, mi, h_x, h_y, kl, js (nats) of a table of (a, b, i, j); cells where q is 0 don't count in kl.

    One aggregation of the rows to cells, few for each pair; the rest are windows and sums over these.
    """
    keys = list(PAIR)
    joint = cells.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("c"))
    part = lambda c, *g: F.sum(c).over(Window.partitionBy(*keys, *g)).cast("double")
    f = joint.select(*keys, "c", part("c", "i").alias("ci"), part("c", "j").alias("cj"), part("c").alias("n"))
    mi = f.groupBy(*keys).agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("ci") * F.col("cj")))).alias("mi"))
    sides = F.array(F.struct(F.col("i").alias("k"), F.col("c").alias("ci"), F.lit(0).cast("long").alias("cj")), F.struct(F.col("j").alias("k"), F.lit(0).cast("long").alias("ci"), F.col("c").alias("cj")))
    both = joint.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s.k").agg(F.sum("s.ci").alias("ci"), F.sum("s.cj").alias("cj"))
    both = both.withColumn("n", part("ci"))
    p, q = F.col("ci") / F.col("n"), F.col("cj") / F.col("n")
    m = (p + q) / 2

    def term(u: Column, v: Column) -> Column:
        ok = (u > 0) & (v > 0)
        return F.sum(F.when(ok, u * F.ln(F.when(ok, u / v))).otherwise(F.lit(0.0)))

    one = both.groupBy(*keys).agg((-term(p, F.when(p > 0, F.lit(1.0)).otherwise(F.lit(0.0)))).alias("h_x"), (-term(q, F.when(q > 0, F.lit(1.0)).otherwise(F.lit(0.0)))).alias("h_y"), term(p, q).alias("kl"), (term(p, m) / 2 + term(q, m) / 2).alias("js"))
    return mi.join(one, keys)


def quantile_bins(pairs: DataFrame, bins: int) -> DataFrame:
    """pairs with qx and qy: min(bins - 1, rank * bins div n) within the pair, ties by time."""
    w = Window.partitionBy(*PAIR)
    n = F.count(F.lit(1)).over(w)
    rank = lambda c: F.row_number().over(w.orderBy(c, "ts_nanos")) - 1
    return pairs.withColumns({f"q{c}": F.least(F.lit(bins - 1).cast("long"), F.floor(rank(c) * bins / n)) for c in ("x", "y")})


def cell_entropy(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, te of cells (keys, next, y, x): sum of p ln(p(next, y, x) p(y) / (p(y, x) p(next, y))), 0 at least."""
    full = cells.groupBy(*keys, "next", "y", "x").agg(F.count(F.lit(1)).alias("c"))
    part = lambda *g: F.sum("c").over(Window.partitionBy(*keys, *g)).cast("double")  # noqa: E731  a few cells a key
    f = full.select(*keys, "c", part("y", "x").alias("cyx"), part("next", "y").alias("cny"), part("y").alias("cy"), part().alias("n"))
    return f.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("cy") / (F.col("cyx") * F.col("cny"))))).alias("te"))


def transfer_entropy(pairs: DataFrame, bins: int = 3, k: int = 1) -> DataFrame:
    """a, b, te: from x to y k rows ahead, quantile bins, history of one row each way; 0 at least."""
    o = Window.partitionBy(*PAIR).orderBy("ts_nanos")
    s = quantile_bins(pairs, bins).select(*PAIR, F.lead("qy", k).over(o).alias("next"), F.col("qy").alias("y"), F.col("qx").alias("x")).filter("next IS NOT NULL")
    return cell_entropy(s, list(PAIR))


def history_entropy(pairs: DataFrame, depths: tuple[int, ...] = (1, 2, 3), horizons: tuple[int, ...] = (1,), bins: int = 4) -> DataFrame:
    """a, b, k, l, h, te for every k, l of depths and every h: x's last l rows on y's next one, given y's last k.

    For h above 0, x is set beside y h rows later first, and binned over what is left;
    the earliest row used has max(k, l) rows before it.  A series shorter than
    max(k, l) + 3 has te 0.
    """
    o = Window.partitionBy(*PAIR).orderBy("ts_nanos")
    deepest = max(depths)
    moved = pairs.withColumns({f"y{h}": F.lead("y", h).over(o) for h in horizons})
    tall = moved.select(*PAIR, "ts_nanos", "x", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"y{h}").alias("y")) for h in horizons))).alias("z"))
    tall = tall.select(*PAIR, "z.h", "ts_nanos", "x", "z.y").filter("y IS NOT NULL")
    w = Window.partitionBy(*PAIR, "h")
    n, t = F.count(F.lit(1)).over(w), w.orderBy("ts_nanos")
    rank = lambda c: F.row_number().over(w.orderBy(c, "ts_nanos")) - 1
    q = tall.withColumns({f"q{c}": F.least(F.lit(bins - 1).cast("long"), F.floor(rank(c) * bins / n)) for c in ("x", "y")} | {"n": n})
    lags = {f"{c}{k}": F.lag(f"q{c}", k).over(t) for c in ("x", "y") for k in range(deepest)}
    q = q.withColumns(lags | {"i": F.row_number().over(t) - 1, "next": F.lead("qy").over(t)}).filter("next IS NOT NULL")
    past = lambda c, k: F.concat_ws(",", *(f"{c}{i}" for i in range(k)))
    grid = [F.struct(F.lit(k).alias("k"), F.lit(l).alias("l"), past("y", k).alias("y"), past("x", l).alias("x")) for k in depths for l in depths]
    cells = q.select(*PAIR, "h", "i", "n", "next", F.explode(F.array(*grid)).alias("g")).select(*PAIR, "h", "i", "n", "next", "g.*")
    used = (F.col("i") >= F.greatest("k", "l")) & (F.col("n") >= F.greatest("k", "l") + 3)
    keys = [*PAIR, "k", "l", "h"]
    every = cells.select(*keys).distinct()
    return every.join(cell_entropy(cells.filter(used), keys), keys, "left").withColumn("te", F.coalesce("te", F.lit(0.0)))


def renyi_entropy(cells: DataFrame, keys: list[str], column: str, alphas: tuple[float, ...]) -> DataFrame:
    """keys, alpha, h: Renyi entropy (nats) of the shares of each value of column; alpha 1 is Shannon's."""
    counts = cells.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    tall = counts.withColumn("p", p).select(*keys, "p", F.explode(F.lit(list(alphas))).alias("alpha"))
    one = F.abs(F.col("alpha") - 1) < 1e-9
    h = F.when(F.max(one), -F.sum(F.col("p") * F.ln("p"))).otherwise(F.ln(F.sum(F.pow("p", "alpha"))) / F.max(F.when(~one, 1 - F.col("alpha"))))
    return tall.groupBy(*keys, "alpha").agg(h.alias("h"))


def correlation_matrix(pairs: DataFrame, rank: bool = False) -> DataFrame:
    """i, j, rho of all series, both ways and with itself: Pearson, or Spearman."""
    half = (spearman if rank else pearson)(pairs)
    cells = half.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), "rho"), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), "rho"))).alias("c")).select("c.*")
    names = half.select(F.explode(F.array("a", "b")).alias("i")).distinct()
    return cells.unionByName(names.select("i", F.col("i").alias("j"), F.lit(1.0).alias("rho")))


def tail_dependence(pairs: DataFrame, q: float = 0.9) -> DataFrame:
    """a, b, upper, lower: shares of joint exceedances of the empirical copula."""
    r = with_ranks(pairs)
    n = F.count(F.lit(1)).over(Window.partitionBy(*PAIR))
    u = r.select(*PAIR, (F.col("x") / (n + 1)).alias("u"), (F.col("y") / (n + 1)).alias("v"))
    total = F.count(F.lit(1))
    return u.groupBy(*PAIR).agg((F.count_if((F.col("u") > q) & (F.col("v") > q)) / (total * (1 - q))).alias("upper"), (F.count_if((F.col("u") <= 1 - q) & (F.col("v") <= 1 - q)) / (total * (1 - q))).alias("lower"))


def gumbel(tau: Column) -> Column:
    return F.greatest(F.lit(1.0), 1 / (1 - F.least(tau, F.lit(0.999))))


def clayton(tau: Column) -> Column:
    return F.greatest(F.lit(0.0), 2 * tau / (1 - F.least(tau, F.lit(0.999))))


def sign_hits(pairs: DataFrame, by: tuple[str, ...] = (), least: int = 30) -> DataFrame:
    """a, b, n, hit, z: how often the signs of x and y agree, zeros dropped; below `least` hit 0.5, z 0."""
    d = pairs.filter((F.col("x") != 0) & (F.col("y") != 0))
    same = F.count_if(F.signum("x") == F.signum("y"))
    n = F.count(F.lit(1))
    hit = F.when(n >= least, same / n).otherwise(F.lit(0.5))
    return d.groupBy(*PAIR, *by).agg(n.alias("n"), hit.alias("hit"), F.when(n >= least, (same / n - 0.5) / F.sqrt(0.25 / n)).otherwise(F.lit(0.0)).alias("z"))


def lead_lag(pairs: DataFrame, most: int = 5) -> DataFrame:
    """a, b, lag, rho: the lag of largest |rho| (first wins), x against y `lag` rows later, over both global deviations."""
    w = Window.partitionBy(*PAIR)
    o = w.orderBy("ts_nanos")
    d = pairs.withColumns({"x": F.col("x") - F.avg("x").over(w), "y": F.col("y") - F.avg("y").over(w)})
    d = d.withColumns({f"y{k + most}": (F.lead("y", k) if k >= 0 else F.lag("y", -k)).over(o) for k in range(-most, most + 1)})
    n, sx, sy = F.count(F.lit(1)), F.sqrt(F.sum(F.col("x") * F.col("x"))), F.sqrt(F.sum(F.col("y") * F.col("y")))
    ok = (sx > 0) & (sy > 0)
    cells = [F.struct((F.sum(F.col("x") * F.col(f"y{k + most}")) / F.when(ok, sx * sy)).alias("rho"), F.lit(k).alias("lag")) for k in range(-most, most + 1)]
    g = d.groupBy(*PAIR).agg(F.array(*cells).alias("all"), n.alias("n")).filter(F.col("n") >= 2 * most + 10)
    top = F.array_max(F.transform("all", lambda c: F.struct(F.round(F.abs(c["rho"]), 12).alias("size"), (-c["lag"]).alias("early"), c["rho"].alias("rho"), c["lag"].alias("lag"))))
    return g.withColumn("top", top).select(*PAIR, F.col("top.lag").alias("lag"), F.col("top.rho").alias("rho"))


def engle_granger(pairs: DataFrame, least: int = 30) -> DataFrame:
    """a, b, n, alpha, beta, resid_std, adf_t: y on x, and the residual's Dickey-Fuller t with intercept, no lag."""
    fit = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha")).filter(F.col("n") >= least)
    o = Window.partitionBy(*PAIR).orderBy("ts_nanos")
    e = pairs.join(fit, list(PAIR)).select(*PAIR, "ts_nanos", "n", "alpha", "beta", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).alias("e"))
    e = e.withColumns({"e1": F.lag("e").over(o)})
    e = e.withColumn("de", F.col("e") - F.col("e1"))
    m, slope = F.regr_count("de", "e1"), F.regr_slope("de", "e1")
    sse = F.regr_syy("de", "e1") - slope * F.regr_sxy("de", "e1")
    se = F.sqrt(sse / (m - 2) / F.regr_sxx("de", "e1"))
    return e.groupBy(*PAIR, "n", "alpha", "beta").agg(F.stddev_samp("e").alias("resid_std"), (slope / se).alias("adf_t"))


def ou_fit(df: DataFrame, key: str, value: str, time: str = "ts_nanos") -> DataFrame:
    """key, theta, mu, sigma, half_life from the AR(1) fit; only 0 < b < 1 with ten rows or more."""
    o = Window.partitionBy(key).orderBy(time)
    d = df.select(key, F.col(value).alias("x"), F.lag(value).over(o).alias("p"))
    g = d.groupBy(key).agg(F.regr_count("x", "p").alias("n"), F.regr_slope("x", "p").alias("b"), F.regr_intercept("x", "p").alias("c"), F.regr_syy("x", "p").alias("syy"), F.regr_sxy("x", "p").alias("sxy"))
    g = g.filter((F.col("n") >= 9) & (F.col("b") > 0) & (F.col("b") < 1))
    theta = -F.ln("b")
    resid = F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2))
    return g.select(key, theta.alias("theta"), (F.col("c") / (1 - F.col("b"))).alias("mu"), (resid * F.sqrt(2 * theta / (1 - F.col("b") * F.col("b")))).alias("sigma"), (math.log(2) / theta).alias("half_life"))


def dcca(pairs: DataFrame, scale: int) -> DataFrame:
    """a, b, rho: detrended cross-correlation at one scale, windows side by side, linear detrending."""
    w = Window.partitionBy(*PAIR)
    o = w.orderBy("ts_nanos")
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    d = pairs.withColumns({"x": F.col("x") - F.avg("x").over(w), "y": F.col("y") - F.avg("y").over(w)})
    d = d.select(*PAIR, (F.row_number().over(o) - 1).alias("i"), F.sum("x").over(run).alias("px"), F.sum("y").over(run).alias("py"))
    d = d.withColumn("k", F.floor(F.col("i") / scale)).withColumn("i", (F.col("i") % scale).cast("double"))
    g = d.groupBy(*PAIR, "k").agg(F.count(F.lit(1)).alias("m"), F.regr_syy("px", "i").alias("xx"), F.regr_sxy("px", "i").alias("xi"), F.regr_sxx("px", "i").alias("ii"), F.regr_syy("py", "i").alias("yy"), F.regr_sxy("py", "i").alias("yi"), (F.covar_pop("px", "py") * F.count(F.lit(1))).alias("xy")).filter(F.col("m") == scale)
    fxy, fxx, fyy = (F.avg(F.col(a) - F.col(b) * F.col(c) / F.col("ii")) for a, b, c in (("xy", "xi", "yi"), ("xx", "xi", "xi"), ("yy", "yi", "yi")))
    ok = (fxx > 0) & (fyy > 0)
    return g.groupBy(*PAIR).agg(F.when(ok, fxy / F.sqrt(F.when(ok, fxx * fyy))).otherwise(F.lit(0.0)).alias("rho"))
