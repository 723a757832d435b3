"""Costs, risk checks, allocation, performance metrics, regimes and recommendations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION_SECONDS = 6.5 * 3600
# Regulatory fees on sales
SEC_PERCENT, TAF_PER_SHARE = 0.00278, 0.000166


def periods_per_year(span_secs: Column | float):
    return 252 * SESSION_SECONDS / (F.greatest(span_secs, F.lit(1)) if isinstance(span_secs, Column) else max(span_secs, 1))


def fill_price(mid: Column, side: Column, qty: Column, half_spread: Column, adv: Column, impact: float = 0.1) -> Column:
    """mid moved against the order by half spread and square-root impact; 0 at least."""
    slip = half_spread + impact * F.sqrt(F.coalesce(F.try_divide(qty, adv), F.lit(0.0))) * mid
    return F.greatest(mid + side * slip, F.lit(0.0))


def fees(side: Column, qty: Column, price: Column) -> Column:
    return F.when(side < 0, qty * price * SEC_PERCENT / 100 + qty * TAF_PER_SHARE).otherwise(F.lit(0.0))


def pretrade(halted: Column, price: Column, qty: Column, nav: Column, power: Column, adv: Column, order_cap: float = 25_000, name_cap: float = 0.05, adv_cap: float = 0.01, cushion: float = 0.95) -> Column:
    """The first reason that rejects an order, or 'accepted'."""
    notional = F.abs(qty) * price
    finite = ~F.isnan(price) & (price < float("inf"))
    return (
        F.when(halted, "halted")
        .when(price.isNull() | (price <= 0), "no_price")
        .when(~finite, "not_finite")
        .when(qty.isNull() | (qty == 0), "quantity")
        .when(notional > order_cap, "fat_finger")
        .when((nav > 0) & (notional > name_cap * nav), "name_cap")
        .when((power > 0) & (notional > power * cushion), "buying_power")
        .when((adv > 0) & (F.abs(qty) > adv_cap * adv), "adv")
        .otherwise("accepted")
    )


def kill_level(triggers: dict[str, tuple[Column, int]]) -> Column:
    """The strictest level of the triggers that fire, 0 if none does."""
    return F.array_max(F.array(F.lit(0), *(F.when(c, F.lit(level)).otherwise(F.lit(0)) for c, level in triggers.values())))


def allocate(df: DataFrame, keys: list[str], cap: float = 0.25, gross: float = 1.0, net: float = 0.3, target_vol: float = 0.10) -> DataFrame:
    """weight of each strategy from desired, sharpe, vol and portfolio_vol.

    Capped at half Kelly (sharpe / vol / 2, from 0 to cap), scaled to gross,
    shifted evenly to net, then scaled down, never up, to the target volatility.
    """
    w = Window.partitionBy(*keys)
    half = F.when(F.col("vol") > 0, F.greatest(F.lit(0.0), F.least(F.lit(cap), F.col("sharpe") / F.when(F.col("vol") > 0, F.col("vol")) / 2))).otherwise(F.lit(0.0))
    d = df.withColumn("w", F.when(F.col("desired") >= 0, 1.0).otherwise(-1.0) * F.least(F.abs("desired"), half))
    total = F.sum(F.abs("w")).over(w)
    d = d.withColumn("w", F.when(total > gross, F.col("w") * gross / F.when(total > 0, total)).otherwise(F.col("w")))
    tilt, n = F.sum("w").over(w), F.count(F.lit(1)).over(w)
    d = d.withColumn("w", F.when(F.abs(tilt) > net, F.col("w") - (tilt - F.signum(tilt) * net) / n).otherwise(F.col("w")))
    risk = F.col("portfolio_vol")
    return d.withColumn("weight", F.when(risk > 0, F.col("w") * F.least(F.lit(1.0), target_vol / F.when(risk > 0, risk))).otherwise(F.col("w"))).drop("w")


def returns_of(equity: DataFrame, keys: list[str], time: str = "ts_nanos", nav: str = "nav") -> DataFrame:
    """equity with r (0 where the last nav isn't positive; null on the first row) and drawdown from the running peak."""
    o = Window.partitionBy(*keys).orderBy(time)
    before, peak = F.lag(nav).over(o), F.max(nav).over(o.rowsBetween(Window.unboundedPreceding, 0))
    r = F.when(before.isNull(), F.lit(None).cast("double")).when(before > 0, F.col(nav) / F.when(before > 0, before) - 1).otherwise(F.lit(0.0))
    return equity.withColumns({"r": r, "drawdown": F.when(peak > 0, (peak - F.col(nav)) / F.when(peak > 0, peak)).otherwise(F.lit(0.0))})


def metrics(equity: DataFrame, keys: list[str], span_secs: float, time: str = "ts_nanos", nav: str = "nav") -> DataFrame:
    """Fourteen measures of an equity curve for each key."""
    d = returns_of(equity, keys, time, nav)
    ppy = periods_per_year(span_secs)
    n, r = F.count(F.lit(1)), F.col("r")
    first, last = F.min_by(nav, time), F.max_by(nav, time)
    years = (F.max(time) - F.min(time)) / 1e9 / (252 * SESSION_SECONDS)
    win, loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    base = d.groupBy(*keys).agg(
        n.alias("n_periods"),
        (last / first - 1).alias("total_return"),
        F.when((years > 0) & (first > 0) & (last > 0), F.pow(last / first, 1 / F.when(years > 0, years)) - 1).otherwise(F.lit(0.0)).alias("cagr"),
        F.avg("r").alias("mean"),
        F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("down"),
        F.max("drawdown").alias("max_drawdown"),
        F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"),
        F.coalesce(F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(win, F.lit(0.0)).alias("gain"),
        F.coalesce(loss, F.lit(0.0)).alias("pain"),
        F.max("r").alias("best"),
        F.min("r").alias("worst"),
    )
    root = math.sqrt(ppy)
    return base.select(
        *keys,
        "n_periods",
        "total_return",
        "cagr",
        (F.col("sd") * root).alias("ann_vol"),
        F.when(F.col("sd") > 0, F.col("mean") / F.when(F.col("sd") > 0, F.col("sd")) * root).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(F.col("down") > 0, F.col("mean") / F.when(F.col("down") > 0, F.col("down")) * root).otherwise(F.lit(0.0)).alias("sortino"),
        F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))).otherwise(F.lit(0.0)).alias("calmar"),
        "max_drawdown",
        "ulcer",
        "hit_rate",
        F.when(F.col("pain") > 0, F.col("gain") / F.when(F.col("pain") > 0, F.col("pain"))).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("profit_factor"),
        "mean",
        "best",
        "worst",
    )


def regime_metrics(equity: DataFrame, keys: list[str], span_secs: float, time: str = "ts_nanos", nav: str = "nav") -> DataFrame:
    """keys, regime, n, mean, ann_vol, sharpe, total_return, max_drawdown: returns belong to the later point's regime."""
    d = returns_of(equity, keys, time, nav).filter("r IS NOT NULL")
    o = Window.partitionBy(*keys, "regime").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("grown", F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).over(o)))
    d = d.withColumn("dd", 1 - F.col("grown") / F.greatest(F.max("grown").over(o), F.lit(1.0)))
    root = math.sqrt(periods_per_year(span_secs))
    g = d.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), (F.max_by("grown", time) - 1).alias("total_return"), F.max("dd").alias("max_drawdown"))
    ok = F.col("n") >= 2
    zero = F.lit(0.0)
    return g.select(*keys, "regime", "n", F.when(ok, F.col("mean")).otherwise(zero).alias("mean"), F.when(ok, F.col("sd") * root).otherwise(zero).alias("ann_vol"), F.when(ok & (F.col("sd") > 0), F.col("mean") / F.when(F.col("sd") > 0, F.col("sd")) * root).otherwise(zero).alias("sharpe"), F.when(ok, F.col("total_return")).otherwise(zero).alias("total_return"), F.when(ok, F.col("max_drawdown")).otherwise(zero).alias("max_drawdown"))


def recommend(by_regime: DataFrame, strategy: str) -> DataFrame:
    """regime, best, sharpe, runner_up, runner_sharpe."""
    o = Window.partitionBy("regime").orderBy(F.desc("sharpe"), strategy)
    d = by_regime.withColumns({"__k": F.row_number().over(o), "runner_up": F.lead(strategy).over(o), "runner_sharpe": F.lead("sharpe").over(o)})
    return d.filter("__k = 1").select("regime", F.col(strategy).alias("best"), "sharpe", "runner_up", "runner_sharpe")


def report_metrics(equity: DataFrame, keys: list[str], time: str = "ts_nanos", nav: str = "nav") -> DataFrame:
    """keys, total_return_pct, sharpe_daily of a backtest report: finite returns, 252 periods a year, 0 below three points or without spread."""
    o = Window.partitionBy(*keys).orderBy(time)
    r = F.try_divide(F.col(nav).cast("double"), F.lag(nav).over(o).cast("double")) - 1
    first, last = F.min_by(nav, time), F.max_by(nav, time)
    sd = F.stddev_samp("r")
    sharpe = F.when((F.count(F.lit(1)) >= 3) & (sd > 0), F.avg("r") / F.when(sd > 0, sd) * math.sqrt(252)).otherwise(F.lit(0.0))
    return equity.withColumn("r", r).groupBy(*keys).agg(F.when(first > 0, (last / F.when(first > 0, first) - 1) * 100).otherwise(F.lit(0.0)).alias("total_return_pct"), sharpe.alias("sharpe_daily"))


def format_report(by_regime: DataFrame) -> DataFrame:
    """regime, line: one readable line for each regime of recommend()'s rows."""
    number = lambda c: F.format_number(F.coalesce(c, F.lit(0.0)), 3)
    runner = F.when(F.col("runner_up").isNull(), F.lit("")).otherwise(F.concat(F.lit(", then "), "runner_up", F.lit(" ("), number(F.col("runner_sharpe")), F.lit(")")))
    return by_regime.select("regime", F.concat("regime", F.lit(": "), "best", F.lit(" ("), number(F.col("sharpe")), F.lit(")"), runner).alias("line"))


def regime_occupancy(equity: DataFrame, keys: list[str], time: str = "ts_nanos", nav: str = "nav") -> DataFrame:
    """keys, regime, occupancy (share of the key's returns), win_rate, profit_factor of the returns in each regime."""
    d = returns_of(equity, keys, time, nav).filter("r IS NOT NULL")
    r = F.col("r")
    g = d.groupBy(*keys, "regime").agg(F.count(F.lit(1)).alias("__n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("__gain"), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0)).alias("__pain"))
    factor = F.when(F.col("__pain") > 0, F.col("__gain") / F.when(F.col("__pain") > 0, F.col("__pain"))).when(F.col("__gain") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    whole = F.sum("__n").over(Window.partitionBy(*keys))
    return g.select(*keys, "regime", (F.col("__n") / whole).alias("occupancy"), "win_rate", factor.alias("profit_factor"))


def strategy_report(overall: DataFrame, by_regime: DataFrame, occupancy: DataFrame, strategy: str) -> DataFrame:
    """strategy, place, line: for each strategy a line of its overall measures (place 0), then one for each regime, in order.

    overall: metrics(); by_regime: regime_metrics(); occupancy: regime_occupancy(), all by the strategy.
    """
    number = lambda c, places: F.format_string(f"%.{places}f", F.coalesce(F.col(c), F.lit(0.0)))
    percent = lambda c, places: F.format_string(f"%.{places}f%%", 100 * F.coalesce(F.col(c), F.lit(0.0)))

    def line(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    head = overall.select(strategy, F.lit("").alias("regime"), line("overall: return ", percent("total_return", 2), ", sharpe ", number("sharpe", 3), ", sortino ", number("sortino", 3), ", drawdown ", percent("max_drawdown", 2), ", wins ", percent("hit_rate", 2)).alias("line"))
    both = by_regime.join(occupancy, [strategy, "regime"])
    rows = both.select(strategy, "regime", line(F.col("regime"), ": ", percent("occupancy", 1), " of the time, n ", F.col("n").cast("string"), ", return ", percent("total_return", 2), ", sharpe ", number("sharpe", 3), ", drawdown ", percent("max_drawdown", 2), ", wins ", percent("win_rate", 2), ", profit factor ", number("profit_factor", 2)).alias("line"))
    place = F.row_number().over(Window.partitionBy(strategy).orderBy("regime")) - 1
    return head.unionByName(rows).select(strategy, place.cast("int").alias("place"), "line")
