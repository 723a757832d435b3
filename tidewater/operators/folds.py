"""Recurrences in the JVM: associative scans where steps compose, folds over a sorted array of each key where not.

Means and variances by exponential decay, forecasts, variance filters and hedge
ratios are scans over blocks of time (operators.scans): a key may have any number
of rows.  The others need the rows of one key in order, so memory is one key's
rows; keys with very many rows belong in the streaming operators there, which
keep only state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater import scratch
from tidewater.operators.scans import Blocks, Maps, once, states_of


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """keys and `state`: the last state of each key."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *columns)))
    return df.groupBy(*keys).agg(rows.alias("__rows")).select(*keys, F.aggregate("__rows", start, step).alias("state"))


def scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, order, columns and `state` after each row."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *columns)))
    g = df.groupBy(*keys).agg(rows.alias("__rows"))
    g = g.withColumn("__states", states_of(F.col("__rows"), start, step))
    return g.select(*keys, F.explode(F.arrays_zip("__rows", "__states")).alias("z")).select(*keys, "z.__rows.*", F.col("z.__states").alias("state"))


def d(x: float) -> Column:
    return F.lit(float(x))


def ema(df: DataFrame, keys: list[str], time: str, value: str, half_life: float, rows: int | None = None) -> DataFrame:
    """mean and var by exponential decay; the first value seeds the mean, the variance starts at 0.

    The mean is affine in the mean before; the variance is affine in the one before
    and quadratic in that mean, so a block is six coefficients.  rows: of a block.
    """
    alpha = 1 - 2 ** (-1 / half_life)
    keep = 1 - alpha

    def step(s: Column, x: Column) -> Column:
        diff = x[value] - s["mean"]
        go = F.struct((s["mean"] + alpha * diff).alias("mean"), (keep * (s["var"] + alpha * diff * diff)).alias("var"))
        return F.when(s["mean"].isNull(), F.struct(x[value].cast("double").alias("mean"), d(0).alias("var"))).otherwise(go)

    def of_row(x: Column) -> Column:
        v = x[value].cast("double")
        # mean -> p mean + q, var -> c var + e mean^2 + f mean + g; (mean, var) from no state
        parts = {"p": d(keep), "q": alpha * v, "c": d(keep), "e": d(alpha * keep), "f": -2 * alpha * keep * v, "g": alpha * keep * v * v, "mean": v, "var": d(0)}
        return F.struct(*(c.alias(k) for k, c in parts.items()))

    def after(m: Column, mean: Column, var: Column) -> dict[str, Column]:
        return {"mean": m["p"] * mean + m["q"], "var": m["c"] * var + (m["e"] * mean + m["f"]) * mean + m["g"]}

    def compose(a: Column, b: Column) -> Column:
        parts = {
            "p": b["p"] * a["p"], "q": b["p"] * a["q"] + b["q"], "c": b["c"] * a["c"],
            "e": b["c"] * a["e"] + b["e"] * a["p"] * a["p"],
            "f": b["c"] * a["f"] + (2 * b["e"] * a["q"] + b["f"]) * a["p"],
            "g": b["c"] * a["g"] + (b["e"] * a["q"] + b["f"]) * a["q"] + b["g"],
        } | after(b, a["mean"], a["var"])
        return F.struct(*(c.alias(k) for k, c in parts.items()))

    def apply(m: Column, s: Column) -> Column:
        go = F.struct(*(c.alias(k) for k, c in after(m, s["mean"], s["var"]).items()))
        return F.when(s["mean"].isNull(), F.struct(m["mean"].alias("mean"), m["var"].alias("var"))).otherwise(go)

    start = F.struct(F.lit(None).cast("double").alias("mean"), d(0).alias("var"))
    blocks = Blocks.of(df, keys, [time], [value], rows)
    return blocks.told(Maps.from_row(of_row, compose, apply, start), "__start").replay(F.col("__start"), step).select(*keys, time, value, "state.*")


def cusum(df: DataFrame, keys: list[str], time: str, value: str, mean: float, slack: float, limit: float) -> DataFrame:
    """up and down sums and the break (1, -1 or 0); both sums start anew after a break, upward tested first."""

    def step(s: Column, x: Column) -> Column:
        dev = x[value] - mean
        up, down = F.greatest(d(0), s["up"] + dev - slack), F.least(d(0), s["down"] + dev + slack)
        broke = F.when(up > limit, 1).when(down < -limit, -1).otherwise(0)
        return F.struct(F.when(broke == 0, up).otherwise(d(0)).alias("up"), F.when(broke == 0, down).otherwise(d(0)).alias("down"), broke.alias("broke"))

    return scan(df, keys, [time], [value], F.struct(d(0).alias("up"), d(0).alias("down"), F.lit(0).alias("broke")), step).select(*keys, time, value, "state.*")


def kalman_beta(df: DataFrame, keys: list[str], time: str, x: str, y: str, q: float = 1e-5, r: float = 1e-3, rows: int | None = None) -> DataFrame:
    """beta, spread and z of y against beta x; the first row sets beta = y / x and has spread 0.

    The variance p is a Moebius map of the one before, p -> (r p + r q) / (x^2 p + x^2 q + r),
    so 2 x 2 matrices compose; with p known before each block, beta is affine in
    the beta before.  rows: of a block.
    """

    def gain(p: Column, xv: Column) -> tuple[Column, Column, Column]:
        ahead = p + q
        big = xv * xv * ahead + r
        return xv * ahead / big, ahead, big

    def step(s: Column, row: Column) -> Column:
        xv, yv = row[x], row[y]
        k, p, big = gain(s["p"], xv)
        e = yv - s["beta"] * xv
        go = F.struct((s["beta"] + k * e).alias("beta"), ((1 - k * xv) * p).alias("p"), e.alias("spread"), (e / F.sqrt(big)).alias("z"))
        first = F.struct(F.coalesce(F.try_divide(yv, xv), d(0)).alias("beta"), d(1).alias("p"), d(0).alias("spread"), d(0).alias("z"))
        return F.when(s["beta"].isNull(), first).otherwise(go)

    def matrix(row: Column) -> Column:
        square = row[x] * row[x]
        return F.struct(d(r).alias("a"), d(r * q).alias("b"), square.alias("c"), (square * q + r).alias("e"), d(1).alias("p"))

    def product(m: Column, n: Column) -> Column:
        def scaled(v: Column) -> Column:
            a, b, c, e = (F.get(v, F.lit(k)) for k in range(4))
            size = a + b + c + e  # all are positive
            return F.struct((a / size).alias("a"), (b / size).alias("b"), (c / size).alias("c"), (e / size).alias("e"), moved(n, m["p"]).alias("p"))

        entries = (n["a"] * m["a"] + n["b"] * m["c"], n["a"] * m["b"] + n["b"] * m["e"], n["c"] * m["a"] + n["e"] * m["c"], n["c"] * m["b"] + n["e"] * m["e"])
        return once(F.array(*entries), scaled)

    def moved(m: Column, p: Column) -> Column:
        return (m["a"] * p + m["b"]) / (m["c"] * p + m["e"])

    blocks = Blocks.of(df, keys, [time], [x, y], rows)
    known = blocks.told(Maps.from_row(matrix, product, lambda m, p: F.when(p.isNull(), m["p"]).otherwise(moved(m, p)), F.lit(None).cast("double")), "__p")

    def of_rows(rows_: Column) -> Column:
        def more(s: Column, row: Column) -> Column:
            k, p, _ = gain(s["p"], row[x])
            rest = 1 - k * row[x]
            go = F.struct((rest * p).alias("p"), (rest * s["u"]).alias("u"), (rest * s["v"] + k * row[y]).alias("v"), (rest * s["beta"] + k * row[y]).alias("beta"))
            first = F.struct(d(1).alias("p"), d(0).alias("u"), d(0).alias("v"), F.coalesce(F.try_divide(row[y], row[x]), d(0)).alias("beta"))
            return F.when(s["p"].isNull(), first).otherwise(go)

        none = F.struct(F.col("__p").alias("p"), d(1).alias("u"), d(0).alias("v"), d(0).alias("beta"))
        return F.aggregate(rows_, none, more)

    def joined(m: Column, n: Column) -> Column:
        return F.struct(n["p"].alias("p"), (n["u"] * m["u"]).alias("u"), (n["u"] * m["v"] + n["v"]).alias("v"), (n["u"] * m["beta"] + n["v"]).alias("beta"))

    # beta -> u beta + v; from no state, beta
    betas = Maps(of_rows, joined, lambda m, b: F.when(b.isNull(), m["beta"]).otherwise(m["u"] * b + m["v"]), F.lit(None).cast("double"))
    start = F.struct(F.col("__beta").alias("beta"), F.coalesce("__p", d(1)).alias("p"), d(0).alias("spread"), d(0).alias("z"))
    return known.told(betas, "__beta").replay(start, step).select(*keys, time, "state.beta", "state.spread", "state.z")


def garch_filter(df: DataFrame, keys: list[str], time: str, value: str, omega: float, alpha: float, beta: float, rows: int | None = None) -> DataFrame:
    """var: omega + alpha r(previous)^2 + beta var, from the stationary variance; the first row uses its own return.

    A block maps (var, r) to (a var + c r^2 + b, its last r).  rows: of a block.
    """
    base = omega / (1 - alpha - beta)

    def step(s: Column, row: Column) -> Column:
        before = F.coalesce(s["r"], row[value])
        return F.struct((omega + alpha * before * before + beta * s["var"]).alias("var"), row[value].cast("double").alias("r"))

    def of_row(row: Column) -> Column:
        v = row[value].cast("double")
        return F.struct(d(beta).alias("a"), d(alpha).alias("c"), d(omega).alias("b"), (omega + alpha * v * v + beta * base).alias("var"), v.alias("r"))

    def after(m: Column, var: Column, before: Column) -> Column:
        return m["a"] * var + m["c"] * before * before + m["b"]

    def compose(m: Column, n: Column) -> Column:
        ends = n["a"] * m["b"] + n["c"] * m["r"] * m["r"] + n["b"]
        return F.struct((n["a"] * m["a"]).alias("a"), (n["a"] * m["c"]).alias("c"), ends.alias("b"), after(n, m["var"], m["r"]).alias("var"), n["r"].alias("r"))

    def apply(m: Column, s: Column) -> Column:
        return F.struct(F.when(s["r"].isNull(), m["var"]).otherwise(after(m, s["var"], s["r"])).alias("var"), m["r"].alias("r"))

    start = F.struct(d(base).alias("var"), F.lit(None).cast("double").alias("r"))
    blocks = Blocks.of(df, keys, [time], [value], rows)
    return blocks.told(Maps.from_row(of_row, compose, apply, start), "__start").replay(F.col("__start"), step).select(*keys, time, value, "state.var")


def markov_filter(df: DataFrame, keys: list[str], time: str, value: str, start: list[float], moves: list[list[float]], means: list[float], variances: list[float]) -> DataFrame:
    """probs: filtered state probabilities of a Gaussian Markov chain; the first row uses `start`."""
    n = len(start)
    var = [max(v, 1e-12) for v in variances]

    def step(s: Column, row: Column) -> Column:
        prior = [F.when(s["seen"], sum((F.get(s["p"], F.lit(i)) * moves[i][j] for i in range(n)), d(0))).otherwise(d(start[j])) for j in range(n)]
        like = [F.exp(-(row[value] - means[j]) * (row[value] - means[j]) / (2 * var[j])) / (2 * 3.141592653589793 * var[j]) ** 0.5 for j in range(n)]
        joint = F.array(*(a * b for a, b in zip(prior, like, strict=True)))
        total = F.greatest(F.aggregate(joint, d(0), lambda a, x: a + x), d(1e-300))
        return F.struct(F.transform(joint, lambda x: x / total).alias("p"), F.lit(True).alias("seen"))

    first = F.struct(F.array(*(d(p) for p in start)).alias("p"), F.lit(False).alias("seen"))
    return scan(df, keys, [time], [value], first, step).select(*keys, time, value, F.col("state.p").alias("probs"))


def hawkes_loglik(df: DataFrame, keys: list[str], time: str, mu: float, alpha: float, beta: float) -> DataFrame:
    """loglik of an exponential Hawkes process on times `time` (double), from 0 to the last event."""

    def step(s: Column, row: Column) -> Column:
        gap = row[time] - s["at"]
        decay = F.exp(-beta * gap)
        open_ = s["n"] + s["r"]  # 1 + R of the last event; nothing before the first
        r = decay * open_
        area = mu * gap + alpha / beta * (1 - decay) * open_
        return F.struct(row[time].cast("double").alias("at"), r.alias("r"), d(1).alias("n"), (s["ll"] + F.ln(mu + alpha * r) - area).alias("ll"))

    start = F.struct(d(0).alias("at"), d(0).alias("r"), d(0).alias("n"), d(0).alias("ll"))
    return fold(df, keys, [time], [], start, step).select(*keys, F.col("state.ll").alias("loglik"))


def ewma_forecast(df: DataFrame, keys: list[str], time: str, value: str, half_life: float, rows: int | None = None) -> DataFrame:
    """forecast of each row from the rows before it; null on the first.  rows: of a block."""
    alpha = 1 - 0.5 ** (1 / half_life)

    def step(s: Column, row: Column) -> Column:
        m = F.when(s["m"].isNull(), row[value].cast("double")).otherwise(s["m"] + alpha * (row[value] - s["m"]))
        return F.struct(m.alias("m"), s["m"].alias("forecast"))

    def of_row(row: Column) -> Column:
        v = row[value].cast("double")
        return F.struct(d(1 - alpha).alias("p"), (alpha * v).alias("q"), v.alias("m"))

    def compose(m: Column, n: Column) -> Column:
        return F.struct((n["p"] * m["p"]).alias("p"), (n["p"] * m["q"] + n["q"]).alias("q"), (n["p"] * m["m"] + n["q"]).alias("m"))

    maps = Maps.from_row(of_row, compose, lambda m, s: F.when(s.isNull(), m["m"]).otherwise(m["p"] * s + m["q"]), F.lit(None).cast("double"))
    blocks = Blocks.of(df, keys, [time], [value], rows)
    start = F.struct(F.col("__m").alias("m"), F.lit(None).cast("double").alias("forecast"))
    return blocks.told(maps, "__m").replay(start, step).select(*keys, time, value, "state.forecast")


def _apply_fill(qty: Column, avg: Column, pnl: Column, signed: Column, price: Column) -> Column:
    """Position after a fill: average price, realised profit; a flip restarts the average at the fill."""
    new = qty + signed
    same = (qty == 0) | (F.signum(qty) == F.signum(signed))
    closed = F.least(F.abs(qty), F.abs(signed))
    realised = F.when(same, d(0)).otherwise((price - avg) * closed * F.signum(qty))
    average = (
        F.when(same, F.coalesce(F.try_divide(qty * avg + signed * price, new), d(0)))
        .when(F.abs(new) < 1e-12, d(0))
        .when(F.signum(new) == F.signum(qty), avg)
        .otherwise(price)
    )
    return F.struct(F.when(F.abs(new) < 1e-12, d(0)).otherwise(new).alias("qty"), average.alias("avg"), (pnl + realised).alias("pnl"))


def position_path(fills: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """fills (order, side, qty, price, fees) with `state` (qty, avg, pnl) after each.

    Quantities add up.  With the quantity before a row known, the cost of a position is
    affine in the cost before (a fill adds to it, a partial close takes its share, a
    flip starts anew) and the realised profit is linear in it, so both are scans over
    blocks of time.  rows: of a block.
    """
    fills = fills.select(*keys, *order, F.col("side").cast("double"), F.col("qty").cast("double"), F.col("price").cast("double"), F.col("fees").cast("double"))

    def signed(x: Column) -> Column:
        return x["side"] * x["qty"]

    def step(s: Column, x: Column) -> Column:
        return _apply_fill(s["qty"], s["avg"], s["pnl"], signed(x), x["price"])

    blocks = Blocks.of(fills, keys, order, ["side", "qty", "price", "fees"], rows)
    held = Maps(lambda r: F.aggregate(r, d(0), lambda acc, x: acc + signed(x)), lambda m, n: m + n, lambda m, q: q + m, d(0))
    known = blocks.told(held, "__qty")

    def of_rows(r: Column) -> Column:
        # cost -> a cost + b; pnl -> pnl + c cost + e, for the rows so far
        def more(s: Column, x: Column) -> Column:
            q = signed(x)
            new = s["qty"] + q
            same = (s["qty"] == 0) | (F.signum(s["qty"]) == F.signum(q))
            empty = F.abs(new) < 1e-12
            stays = F.signum(new) == F.signum(s["qty"])
            closed = F.least(F.abs(s["qty"]), F.abs(q))
            share = F.coalesce(F.try_divide(closed, F.abs(s["qty"])), d(0))
            keep = F.when(same, d(1)).when(empty, d(0)).when(stays, 1 - share).otherwise(d(0))
            adds = F.when(same, F.abs(q) * x["price"]).when(empty | stays, d(0)).otherwise(F.abs(new) * x["price"])
            gain = F.when(same, d(0)).otherwise(x["price"] * closed * F.signum(s["qty"]))
            lost = F.when(same, d(0)).otherwise(share * F.signum(s["qty"]))
            return F.struct(F.when(empty, d(0)).otherwise(new).alias("qty"), (keep * s["a"]).alias("a"), (keep * s["b"] + adds).alias("b"), (s["c"] - lost * s["a"]).alias("c"), (s["e"] + gain - lost * s["b"]).alias("e"))

        return F.aggregate(r, F.struct(F.col("__qty").alias("qty"), d(1).alias("a"), d(0).alias("b"), d(0).alias("c"), d(0).alias("e")), more)

    def compose(m: Column, n: Column) -> Column:
        return F.struct(n["qty"].alias("qty"), (n["a"] * m["a"]).alias("a"), (n["a"] * m["b"] + n["b"]).alias("b"), (m["c"] + n["c"] * m["a"]).alias("c"), (m["e"] + n["c"] * m["b"] + n["e"]).alias("e"))

    costs = Maps(of_rows, compose, lambda m, s: F.struct((m["a"] * s["cost"] + m["b"]).alias("cost"), (s["pnl"] + m["c"] * s["cost"] + m["e"]).alias("pnl")), F.struct(d(0).alias("cost"), d(0).alias("pnl")))
    told = known.told(costs, "__cost")
    qty = F.when(F.abs("__qty") < 1e-12, d(0)).otherwise(F.col("__qty"))
    start = F.struct(qty.alias("qty"), F.coalesce(F.try_divide(F.col("__cost.cost"), F.abs(qty)), d(0)).alias("avg"), F.col("__cost.pnl").alias("pnl"))
    return told.replay(start, step)


def positions(fills: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """keys, qty, avg_px, realized_pnl, cash, fees, n_fills after the last of the fills (side, qty, price, fees) in order."""
    path = position_path(fills, keys, order, rows)
    flow = F.sum(-F.col("side") * F.col("qty") * F.col("price") - F.col("fees"))
    last = path.groupBy(*keys).agg(F.max_by("state", F.struct(*order)).alias("s"), flow.alias("cash"), F.sum("fees").alias("fees"), F.count(F.lit(1)).alias("n_fills"))
    return last.select(*keys, F.col("s.qty").alias("qty"), F.col("s.avg").alias("avg_px"), F.col("s.pnl").alias("realized_pnl"), "cash", "fees", "n_fills")


def running_sums(df: DataFrame, order: list[str], columns: list[str], most: int = 20_000) -> DataFrame:
    """df with the columns replaced by their sums over all rows so far, in order, over the whole table.

    Rows are numbered within blocks of the first order column, a number; a window over
    the blocks' sums, `most` rows at most, says what came before each.  So no task has
    more than its blocks.
    """
    time = order[0]
    n, low, high = df.agg(F.count(F.lit(1)), F.min(time), F.max(time)).first()  # one row
    width = max(1, -(-(high - low + 1) // max(1, min(most, n // 1000)))) if n else 1
    rows = df.withColumn("__block", F.floor((F.col(time) - F.lit(low or 0)) / F.lit(width)))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__block").agg(*(F.sum(c).alias(c) for c in columns))
    sums = sums.select("__block", *(F.coalesce(F.sum(c).over(before), d(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(c).over(inside) for c in columns}).join(F.broadcast(sums), "__block")
    return rows.withColumns({c: F.col(c) + F.col(f"__{c}") for c in columns}).select(*df.columns)


def _changes(fills: DataFrame, marks: DataFrame, order: list[str], rows: int | None) -> DataFrame:
    """ts_nanos, __side, symbol, __order and what each fill and mark adds to cash, gross and nav of the book."""
    path = position_path(fills, ["symbol"], order, rows)
    told = F.struct(*order)
    f = path.select("symbol", "ts_nanos", F.lit(1).alias("__side"), told.alias("__order"), F.col("state.qty").alias("qty"), F.col("state.avg").alias("avg"), F.lit(None).cast("double").alias("mark"), (-F.col("side") * F.col("qty") * F.col("price") - F.col("fees")).alias("cash"))
    none = F.lit(None)
    m = marks.select("symbol", "ts_nanos", F.lit(0).alias("__side"), none.cast(f.schema["__order"].dataType).alias("__order"), none.cast("double").alias("qty"), none.cast("double").alias("avg"), F.col("price").cast("double").alias("mark"), d(0).alias("cash"))
    w = Window.partitionBy("symbol").orderBy("ts_nanos", "__side", "__order")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    events = f.unionByName(m).withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("qty", "avg", "mark")})
    events = events.withColumn("nav", F.coalesce("qty", d(0)) * F.coalesce("mark", "avg", d(0)))
    before = F.coalesce(F.lag("nav").over(w), d(0))
    changes = events.withColumns({"gross": F.abs("nav") - F.abs(before), "nav": F.col("nav") - before + F.col("cash")})
    return changes.select("ts_nanos", "__side", "symbol", "__order", "cash", "gross", "nav")


def _held(cash: float) -> list[Column]:
    held = F.col("cash") + cash
    return [held.alias("cash"), F.col("gross"), (F.col("nav") + cash).alias("nav"), F.greatest(held, d(0)).alias("buying_power")]


def portfolio(fills: DataFrame, marks: DataFrame, order: list[str], cash: float = 0.0, rows: int | None = None) -> DataFrame:
    """ts_nanos, symbol, cash, gross, nav, buying_power after each fill and each mark, over all symbols.

    fills: symbol, order (ts_nanos first), side, qty, price, fees; marks: symbol,
    ts_nanos, price.  A symbol is worth its quantity at its last mark, or at its average
    price before its first; a mark comes before fills of its time.  Each event changes
    the worth of its symbol alone, so the book is one running sum of changes.
    buying_power is the cash, if positive.
    """
    changes = scratch.written(_changes(fills, marks, order, rows), "changes")  # read three times
    book = running_sums(changes, ["ts_nanos", "__side", "symbol", "__order"], ["cash", "gross", "nav"])
    return book.select("ts_nanos", "symbol", F.col("__side").alias("kind"), F.col("__order").alias("place"), *_held(cash))


def portfolio_by_time(fills: DataFrame, marks: DataFrame, order: list[str], cash: float = 0.0, rows: int | None = None) -> DataFrame:
    """ts_nanos, cash, gross, nav, buying_power: the book of portfolio() after the last event of each time, from sums by time."""
    columns = ["cash", "gross", "nav"]
    sums = _changes(fills, marks, order, rows).groupBy("ts_nanos").agg(*(F.sum(c).alias(c) for c in columns))
    return running_sums(scratch.written(sums, "changes"), ["ts_nanos"], columns).select("ts_nanos", *_held(cash))


# Loss limits by level, as shares of the capital each is measured from
LADDER = ((7, 0.12), (6, 0.08), (5, 0.05), (4, 0.035), (3, 0.02), (2, 0.01))


def loss_ladder(equity: DataFrame, keys: list[str], time: str, nav: str, new_session: str) -> DataFrame:
    """level after each row: deeper losses escalate, a session's open clears levels 2 to 4, level 7 stays.

    All levels are measured from the first nav of the key, as the simulator feeds them.
    """

    def step(s: Column, row: Column) -> Column:
        first = F.coalesce(s["first"], row[nav].cast("double"))
        loss = (first - row[nav]) / first
        hit = F.coalesce(*(F.when(loss >= limit, F.lit(level)) for level, limit in LADDER), F.lit(0))
        held = F.when(row[new_session] & s["level"].between(2, 4), F.lit(0)).otherwise(s["level"])
        return F.struct(first.alias("first"), F.when(held == 7, F.lit(7)).otherwise(F.greatest(held, hit)).alias("level"))

    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("level"))
    return scan(equity, keys, [time], [nav, new_session], start, step).select(*keys, time, nav, "state.level")
