"""Recurrences over blocks of time against the same recurrences row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import folds
from tidewater.operators.scans import Blocks

SCHEMA = "k string, t long, x double, y double"


def made(n, keys=("a", "b", None), seed=1):
    rng = random.Random(seed)
    return [(k, 17 * i + rng.randrange(17), 4 + rng.random(), 5 + rng.random()) for k in keys for i in range(n if k == "a" else n // 3 or 1)]


def by_key(rows):
    out = {}
    for k, t, x, y in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((t, x, y))
    return out


def ema(rows, half_life=5.0):
    a, out, mean, var = 1 - 2 ** (-1 / half_life), [], None, 0.0
    for t, x, _ in rows:
        if mean is None:
            mean = x
        else:
            d = x - mean
            mean, var = mean + a * d, (1 - a) * (var + a * d * d)
        out.append((t, mean, var))
    return out


def garch(rows, omega=2e-3, alpha=0.1, beta=0.85):
    out, var, last = [], omega / (1 - alpha - beta), None
    for t, x, _ in rows:
        last = x if last is None else last
        var = omega + alpha * last * last + beta * var
        last = x
        out.append((t, var))
    return out


def forecast(rows, half_life=5.0):
    a, out, m = 1 - 0.5 ** (1 / half_life), [], None
    for t, x, _ in rows:
        out.append((t, m))
        m = x if m is None else m + a * (x - m)
    return out


def kalman(rows, q=1e-5, r=1e-3):
    out, beta, p = [], None, 1.0
    for t, x, y in rows:
        if beta is None:
            beta, e, z = y / x, 0.0, 0.0
        else:
            p += q
            e, big = y - beta * x, x * x * p + r
            k = x * p / big
            beta, p, z = beta + k * e, (1 - k * x) * p, e / math.sqrt(big)
        out.append((t, beta, e, z))
    return out


RUNS = {
    "ema": (lambda df, rows: folds.ema(df, ["k"], "t", "x", 5.0, rows).select("k", "t", "mean", "var"), ema),
    "garch": (lambda df, rows: folds.garch_filter(df, ["k"], "t", "x", 2e-3, 0.1, 0.85, rows).select("k", "t", "var"), garch),
    "forecast": (lambda df, rows: folds.ewma_forecast(df, ["k"], "t", "x", 5.0, rows).select("k", "t", "forecast"), forecast),
    "kalman": (lambda df, rows: folds.kalman_beta(df, ["k"], "t", "x", "y", rows=rows).select("k", "t", "beta", "spread", "z"), kalman),
}


@pytest.mark.parametrize("name", sorted(RUNS))
@pytest.mark.parametrize("n,rows", [(1, 7), (400, 7), (20, 1), (100, 100_000)])  # 7: maps of maps; 1: a block for each row
def test_blocks_are_the_recurrence(spark, name, n, rows):
    data, (run, plain) = made(n), RUNS[name]
    got = {}
    for r in run(spark.createDataFrame(data, SCHEMA).repartition(3), rows).collect():
        got.setdefault(r.k, []).append(tuple(r)[1:])
    want = {k: plain(v) for k, v in by_key(data).items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        told = sorted(got[k])
        assert [x[0] for x in told] == [x[0] for x in v]
        assert all((p is None and q is None) or p == pytest.approx(q, rel=1e-9, abs=1e-11) for a, b in zip(told, v, strict=True) for p, q in zip(a[1:], b[1:], strict=True))


def test_a_long_series_is_many_small_blocks(spark):
    """One key at ten times the rows: ten times the blocks, none of them larger."""
    sizes = {}
    for n in (3000, 30_000):
        blocks = Blocks.of(spark.range(n).selectExpr("'a' AS k", "id * 1000 AS t", "double(id) AS x"), ["k"], ["t"], ["x"], 256)
        sizes[n] = blocks.df.select(F.size("__rows")).agg(F.max("size(__rows)"), F.count(F.lit(1))).first()
    assert sizes[3000][0] <= 257 >= sizes[30_000][0] and sizes[30_000][1] > 9 * sizes[3000][1]


def test_empty_and_timeless(spark):
    none = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([("a", None, 1.0, 2.0), ("a", 5, 2.0, 4.0), ("a", 9, 4.0, 8.0)], SCHEMA)
    for run, _ in RUNS.values():
        assert run(none, 7).count() == 0 and run(odd, 1).count() == 3


def plain_position(fills):
    qty = avg = pnl = 0.0
    out = []
    for side, q, price, _ in fills:
        s = side * q
        new, same = qty + s, qty == 0 or (qty > 0) == (s > 0)
        if same:
            avg = (qty * avg + s * price) / new
        else:
            pnl += (price - avg) * min(abs(qty), abs(s)) * (1 if qty > 0 else -1)
            avg = 0.0 if abs(new) < 1e-12 else avg if (new > 0) == (qty > 0) else price
        qty = 0.0 if abs(new) < 1e-12 else new
        out.append((qty, avg, pnl))
    return out


FILLS = "symbol string, ts_nanos long, seq long, side int, qty double, price double, fees double"


def some_fills(n=300, seed=4):
    rng = random.Random(seed)
    return [(rng.choice("ab"), k // 2, k, rng.choice([-1, 1]), float(rng.choice([1, 2, 5, 10])), 50 + rng.random(), 0.25) for k in range(n)]


@pytest.mark.parametrize("rows", [5, 10_000])
def test_positions_over_blocks(spark, rows):
    data = some_fills()
    got = folds.position_path(spark.createDataFrame(data, FILLS).repartition(3), ["symbol"], ["ts_nanos", "seq"], rows).collect()
    for k in "ab":
        mine = sorted((r.seq, tuple(r.state)) for r in got if r.symbol == k)
        want = plain_position([x[3:] for x in data if x[0] == k])
        assert len(mine) == len(want)
        for (_, g), w in zip(mine, want, strict=True):
            assert g == pytest.approx(w, abs=1e-8)


def test_portfolio_against_brute_force(spark):
    data, rng = some_fills(120, 5), random.Random(6)
    marks = [(k, t, 50 + rng.random()) for k in "ab" for t in range(7, 60, 6)]
    got = folds.portfolio(spark.createDataFrame(data, FILLS), spark.createDataFrame(marks, "symbol string, ts_nanos long, price double"), ["ts_nanos", "seq"], 1000.0, rows=7)
    told = {(r.ts_nanos, r.symbol, r.kind, r.place.seq if r.place else None): (r.cash, r.gross, r.nav, r.buying_power) for r in got.collect()}
    events = sorted([(t, 0, k, -1, p) for k, t, p in marks] + [(x[1], 1, x[0], x[2], x) for x in data])
    cash, held, mark, fills = 1000.0, {}, {}, {"a": [], "b": []}
    for t, kind, k, seq, x in events:
        if kind:
            cash -= x[3] * x[4] * x[5] + x[6]
            fills[k].append(x[3:])
            held[k] = plain_position(fills[k])[-1]
        else:
            mark[k] = x
        worth = {s: q * mark.get(s, avg) for s, (q, avg, _) in held.items()}
        want = (cash, sum(map(abs, worth.values())), cash + sum(worth.values()), max(0.0, cash))
        assert told.pop((t, k, kind, seq if kind else None)) == pytest.approx(want, abs=1e-6)
    assert not told


def test_book_by_time_is_the_last_of_each_time_from_one_pass(spark):
    data, rng = some_fills(120, 5), random.Random(7)
    fills = spark.createDataFrame(data, FILLS)
    marks = spark.createDataFrame([(k, t, 50 + rng.random()) for k in "ab" for t in range(7, 60, 6)], "symbol string, ts_nanos long, price double")
    last = {}
    for r in folds.portfolio(fills, marks, ["ts_nanos", "seq"], 1000.0, rows=7).collect():
        place = (r.kind, r.symbol, r.place.seq if r.place else -1)
        last[r.ts_nanos] = max(last.get(r.ts_nanos, ((-1,), None)), (place, (r.cash, r.gross, r.nav, r.buying_power)))
    for rows in (7, None):
        got = folds.portfolio_by_time(fills, marks, ["ts_nanos", "seq"], 1000.0, rows)
        # the events are behind a table of sums by time, not computed anew by each use
        assert "repartition" not in got._jdf.queryExecution().toString() and "__rows" not in got._jdf.queryExecution().toString()
        told = {r.ts_nanos: (r.cash, r.gross, r.nav, r.buying_power) for r in got.collect()}
        assert told.keys() == last.keys()
        for t, x in told.items():
            assert x == pytest.approx(last[t][1], abs=1e-6)


def test_keys_of_one_block_need_no_join(spark):
    path = folds.position_path(spark.createDataFrame(some_fills(), FILLS), ["symbol"], ["ts_nanos", "seq"])
    assert "Join" not in path._jdf.queryExecution().toString()


def test_running_sums_of_nothing_and_one_time(spark):
    none = spark.createDataFrame([], "t long, k long, v double")
    assert folds.running_sums(none, ["t"], ["v"]).count() == 0
    one = spark.createDataFrame([(5, k, 1.0) for k in range(9)], "t long, k long, v double")
    assert sorted(r.v for r in folds.running_sums(one, ["t", "k"], ["v"]).collect()) == [float(k) for k in range(1, 10)]
