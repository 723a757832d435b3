"""Scalar expressions of the domain: safe math, clamps, quotes, option greeks, tails, session clock, calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1e6


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe(c: Column) -> Column:
    """Within +-LIMIT; null and NaN are 0."""
    return clamp(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), -LIMIT, LIMIT)


def safe_divide(a: Column, b: Column) -> Column:
    return safe(F.when(F.abs(b) < 1e-12, F.lit(0.0)).otherwise(F.try_divide(a, b)))


def safe_log(a: Column) -> Column:
    return safe(F.when(F.abs(a) > 1e-12, F.ln(F.when(F.abs(a) > 1e-12, F.abs(a)))).otherwise(F.lit(0.0)))


def safe_tanh(a: Column) -> Column:
    return safe(F.tanh(clamp(a, -50.0, 50.0)))


def quote_mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def half_spread(bid: Column, ask: Column) -> Column:
    return F.when(bid.isNotNull() & ask.isNotNull(), F.greatest(ask - bid, F.lit(0.0)) / 2)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def gamma(spot: Column, strike: Column, iv: Column, years: Column, rate: float = 0.05) -> Column:
    """Black-Scholes gamma without dividends; 0 where any input is degenerate."""
    ok = (spot > 0) & (strike > 0) & (iv > 0) & (years > 0)
    s, k, v, t = (F.when(ok, x) for x in (spot, strike, iv, years))
    d1 = (F.ln(s / k) + (rate + v * v / 2) * t) / (v * F.sqrt(t))
    return F.when(ok, normal_pdf(d1) / (s * v * F.sqrt(t))).otherwise(F.lit(0.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def marchenko_pastur(q: float, variance: float = 1.0) -> tuple[float, float]:
    """Edges of the bulk for q = N / T."""
    return variance * (1 - math.sqrt(q)) ** 2, variance * (1 + math.sqrt(q)) ** 2


def piecewise(x: Column, knots: list[tuple[Column, float]]) -> Column:
    """Linear between (place, value) knots, flat outside."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + F.lit(y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(F.lit(knots[-1][1]))


def adf_p(t: Column, n: Column) -> Column:
    """p of a Dickey-Fuller t statistic, linear between critical values shifted for small n; 0.005 beyond the first."""
    shift = F.when(n < 50, 0.20).when(n < 100, 0.10).when(n < 250, 0.05).otherwise(0.0)
    one, five, ten = (F.lit(c) - shift for c in (-3.43, -2.86, -2.57))
    return F.when(t <= one, F.lit(0.005)).otherwise(piecewise(t, [(one, 0.01), (five, 0.05), (ten, 0.10), (F.lit(0.0), 0.50), (F.lit(5.0), 0.99)]))


def sunday(year: Column, month: int, nth: int) -> Column:
    """Date of the nth Sunday of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, (8 - F.dayofweek(first)) % 7 + 7 * (nth - 1))


def eastern_offset_hours(day: Column) -> Column:
    """-4 from the second Sunday of March up to the first of November, else -5, switched at the UTC day."""
    y = F.year(day)
    return F.when((day >= sunday(y, 3, 2)) & (day < sunday(y, 11, 1)), -4).otherwise(-5)


# Exchange holidays and half days of 2026
HOLIDAYS = ("2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25")
HALF_DAYS = ("2026-11-27", "2026-12-24")


def session_status(ts: Column) -> Column:
    """Closed, Holiday, PreMarket, Regular or PostMarket of a UTC timestamp (without zone) on the US equity clock."""
    local = ts + F.make_interval(hours=eastern_offset_hours(F.to_date(ts)))
    day, minute = F.to_date(local), F.hour(local) * 60 + F.minute(local)
    close = F.when(day.cast("string").isin(*HALF_DAYS), 13 * 60).otherwise(16 * 60)
    return (
        F.when(F.weekday(local) >= 5, "Closed")
        .when(day.cast("string").isin(*HOLIDAYS), "Holiday")
        .when((minute < 4 * 60) | (minute >= 20 * 60), "Closed")
        .when(minute < 9 * 60 + 30, "PreMarket")
        .when(minute < close, "Regular")
        .otherwise("PostMarket")
    )




def to_nanos(date: Column) -> Column:
    return F.unix_date(date).cast("long") * 86_400_000_000_000
