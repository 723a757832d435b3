"""Operators against hand values, numpy and their own streams; look-ahead safety; no session at import."""

import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar
from tidewater.operators import backtests, estimators, excitation, folds, joins, packs, portfolio, rolling, validation
from tidewater.operators.strategies import STRATEGIES, Bar, Simulator, Strategy
from tidewater.sources import generators, readers
from tidewater.streaming import events as streaming

BARS = "ts_nanos long, symbol string, open double, high double, low double, close double, volume double, span_secs int"


def close_bars(spark, closes, symbol="AAA", step=60):
    return spark.createDataFrame([(k * step * 10**9, symbol, c, c, c, c, 100.0, step) for k, c in enumerate(closes)], BARS)


def test_imports_without_a_session():
    code = "import tidewater.catalog, tidewater.session, __spark_entry__; print(len(__spark_entry__.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 80


def test_forward_fill_budget(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (4, "a", 4.0), (2, "b", 9.0)], "t long, k string, v double")
    grid = spark.range(1, 8).withColumnRenamed("id", "t")
    got = {(r.t, r.k): r.v for r in joins.forward_fill(d, grid, "k", "t", "v", budget=1).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 1.0, (4, "a"): 4.0, (5, "a"): 4.0, (2, "b"): 9.0, (3, "b"): 9.0}


def test_asof_inclusive_and_exclusive(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("m", 5, 3)], "k string, t long, id int")
    right = spark.createDataFrame([("k", 5, "five"), ("k", 3, "three")], "k string, t long, name string")
    got = {e: {r.id: r.name for r in joins.asof(left, right, "t", ["k"], ["name"], exclusive=e).collect()} for e in (False, True)}
    assert got == {False: {1: "five", 2: None, 3: None}, True: {1: "three", 2: None, 3: None}}


def test_features_never_look_ahead(spark):
    rng = random.Random(2)
    values = [(k, "s", 100 + rng.random()) for k in range(80)]
    changed = [(k, s, v if k < 60 else v * 3) for k, s, v in values]
    one, two = ({(r.ts_nanos, r.feature): r.value for r in rolling.extract_features(spark.createDataFrame(v, "ts_nanos long, series string, value double")).filter("ts_nanos < 60").collect()} for v in (values, changed))
    assert one.keys() == two.keys() and len({f for _, f in one}) == 5 + 2 * 7  # 63 only from row 63 on
    assert all(one[k] == pytest.approx(two[k], rel=1e-9, abs=1e-9) for k in one)


def test_features_of_flat_and_short_series(spark):
    d = spark.createDataFrame([(k, "flat", 5.0) for k in range(8)] + [(1, "one", -2.0)], "ts_nanos long, series string, value double")
    got = {(r.series, r.ts_nanos, r.feature): r.value for r in rolling.extract_features(d).collect()}
    assert got["flat", 7, "skew_5"] == 0 and got["flat", 7, "kurt_5"] == 0 and ("flat", 7, "zscore_5") not in got
    assert [k for k in got if k[0] == "one"] == [("one", 1, "level")]


def test_validation(spark):
    rows = [(k * 60, "AAA", 10.0, 11.0, 9.0, 10.0, 1.0, 60, k) for k in range(20)] + [(5 * 60, "AAA", 10.0, 11.0, 9.0, 10.5, 1.0, 60, 20), (3000, "AAA", 30.0, 31.0, 29.0, 30.0, 1.0, 60, 21), (3060, "AAA", 0.0, 11.0, 9.0, 10.0, 1.0, 60, 22), (3120, "AAA", 12.0, 11.0, 9.0, 10.0, 1.0, 60, 23)]
    d = spark.createDataFrame(rows, BARS + ", pos long")
    found = {r.type: r.n for r in validation.issues(d, "pos").collect()}
    # order is counted over the rows kept, so a repeated row that goes isn't a step back
    assert found == {"non_positive": 1, "ohlc": 1, "duplicate": 1, "gap": 1, "split": 1}
    # and in file order over all symbols: the second symbol's first row is one
    two = [(k * 60, s, 10.0, 11.0, 9.0, 10.0, 1.0, 60, 100 * i + k, f) for i, s in enumerate(("AAA", "BBB")) for k, f in ((0, "one"), (1, "one"), (2, "one"))]
    t = spark.createDataFrame(two, BARS + ", pos long, file string")
    assert {r.type: r.n for r in validation.issues(t, "pos", "file").collect()} == {"non_monotonic": 1}
    report = validation.file_report(t, "file", "pos").collect()
    assert [(r.rows, r.kept_rows, r.dropped_rows, r.non_monotonic, r.needs_cleaning) for r in report] == [(6, 6, 0, 1, True)]
    assert [r.ts_nanos for r in validation.cleaned(t, "file", "pos").orderBy("place").collect()] == [0, 0, 60, 60, 120, 120]
    assert validation.clean(d, "pos").filter("ts_nanos = 300").first().close == 10.0


def test_adf_p_and_piecewise(spark):
    t = spark.createDataFrame([(x,) for x in (-9.0, -3.43, -2.86, -2.57, 0.0, 9.0)], "t double")
    assert [round(r[0], 6) for r in t.select(scalar.adf_p(F.col("t"), F.lit(1000))).collect()] == [0.005, 0.005, 0.05, 0.1, 0.5, 0.99]


def test_tails():
    assert scalar.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=2e-4)
    assert scalar.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)
    assert scalar.marchenko_pastur(0.25) == pytest.approx((0.25, 2.25))


def test_session_clock(spark):
    t = ["2026-01-05 14:30:00", "2026-01-05 13:00:00", "2026-01-05 21:30:00", "2026-01-19 15:00:00", "2026-01-10 15:00:00", "2026-11-27 18:30:00", "2026-07-01 13:30:00", "2026-01-05 08:59:00"]
    d = spark.createDataFrame([(x,) for x in t], "s string").select(scalar.session_status(F.col("s").cast("timestamp_ntz")).alias("x"))
    assert [r.x for r in d.collect()] == ["Regular", "PreMarket", "PostMarket", "Holiday", "Closed", "PostMarket", "Regular", "Closed"]


def test_position_fold(spark):
    d = spark.createDataFrame([("a", 1, 1, 10.0, 5.0, 0.1), ("a", 2, 1, 10.0, 7.0, 0.1), ("a", 3, -1, 30.0, 8.0, 0.1), ("a", 4, 1, 10.0, 6.0, 0.1)], "k string, t long, side int, qty double, price double, fees double")
    r = folds.positions(d, ["k"], ["t"]).first()
    assert (r.qty, r.avg_px, r.n_fills) == (0.0, 0.0, 4)
    assert r.realized_pnl == pytest.approx(20 * (8 - 6) + 10 * (8 - 6)) and r.cash == pytest.approx(-50 - 70 + 240 - 60 - 0.4)


def test_metrics_of_a_known_curve(spark):
    nav = [100.0, 110.0, 99.0, 99.0]
    d = spark.createDataFrame([("r", k * 10**9, v) for k, v in enumerate(nav)], "run string, ts_nanos long, nav double")
    m = portfolio.metrics(d, ["run"], 60).first()
    assert m.n_periods == 4 and m.total_return == pytest.approx(-0.01) and m.max_drawdown == pytest.approx(0.1) and m.hit_rate == pytest.approx(1 / 3) and m.profit_factor == pytest.approx(1.0)
    flat = portfolio.metrics(d.withColumn("nav", F.lit(1.0)), ["run"], 60).first()
    assert (flat.sharpe, flat.sortino, flat.profit_factor) == (0.0, 0.0, 0.0)


def test_ladder_batch_and_stream_steps(spark):
    rng, nav, rows = random.Random(8), 100.0, []
    for k in range(300):
        nav *= 1 + rng.uniform(-0.012, 0.0117)
        rows.append(("r", k, nav, k % 40 == 0))
    batch = [r.level for r in folds.loss_ladder(spark.createDataFrame(rows, "run string, ts_nanos long, nav double, opens boolean"), ["run"], "ts_nanos", "nav", "opens").orderBy("ts_nanos").collect()]
    state, stream = (math.nan, 0), []
    for _, t, v, o in rows:
        state, out = streaming.ladder_step(state, (t, v, o))
        stream.append(out[2])
    assert batch == stream and max(batch) >= 3


def test_ema_batch_is_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{k % 3}", k, rng.uniform(1, 9)) for k in range(90)]
    schema = "symbol string, ts_nanos long, value double"
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streaming.read_events(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    streaming.run_once(streaming.streaming_ema(s, 5), str(tmp_path / "out"), str(tmp_path / "state"))
    streaming.run_once(streaming.streaming_ema(streaming.read_events(spark, str(tmp_path / "in"), schema), 5), str(tmp_path / "out"), str(tmp_path / "state"))  # a restart adds nothing
    got = {(r.symbol, r.ts_nanos): r.mean for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.symbol, r.ts_nanos): r.mean for r in folds.ema(spark.createDataFrame(rows, schema), ["symbol"], "ts_nanos", "value", 5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_journal_and_audit_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "s", "AAA", ("buy", "long", 2.0), None, {"z": 1.5}, None)], "ts long, strategy string, symbol string, action struct<type:string,side:string,qty:double>, regime string, features map<string,double>, notes string")
    d.write.json(str(tmp_path / "a"))
    from tidewater import schemas

    r = readers.read_jsonl(spark, str(tmp_path / "a"), schemas.AUDIT).first()
    assert r.action.qty == 2.0 and r.features == {"z": 1.5} and r.regime is None


def test_bar_files(spark, tmp_path):
    b = close_bars(spark, [1.0, 2.0])
    readers.write_bars(b, str(tmp_path / "bars"))
    assert sorted(r.close for r in readers.read_bars(spark, str(tmp_path / "bars")).collect()) == [1.0, 2.0]
    (tmp_path / "x.csv").write_text("ts_nanos,series,value\n1,a,2.5\nbad,a,3\n2,a,nan\n")
    assert readers.header_kind(spark, str(tmp_path / "x.csv")) == "series"
    assert [tuple(r) for r in readers.read_series(spark, str(tmp_path / "x.csv")).collect()] == [(1, "a", 2.5, 0)]  # the last: its place in the file
    (tmp_path / "bad.csv").write_text("ts_nanos,symbol,open,high,low,close,volume,span_secs\n1,A,x,1,1,1,1,60\n")
    with pytest.raises(Exception):
        readers.read_bars(spark, str(tmp_path / "bad.csv")).collect()


def test_messages(spark):
    rows = ['[{"T":"t","S":"AAA","t":"2024-01-01T00:00:00.123456Z","p":1.5,"s":2}]', '[{"T":"q","S":"bad symbol","t":"2024-01-01T00:00:00Z"}]', '[{"T":"success"}]', "not json", None, '[{"T":"b","S":"B.B","t":"2024-01-01T00:01:00Z","o":1,"h":2,"l":1,"c":2,"v":9},{"T":"t","S":"C","t":"nonsense","p":1}]']
    got = readers.decode_messages(spark.createDataFrame([(x,) for x in rows], "m string"), "m").orderBy("symbol").collect()
    assert [(r.kind, r.symbol, r.ts_nanos) for r in got] == [("trade", "AAA", 1704067200123456000), ("bar", "B.B", 1704067260000000000)]


def test_html_table_and_dates(spark):
    d = spark.createDataFrame([("<table><tr><th>Symbol</th></tr><tr><td><a>BRK.B</a></td><td> x </td></tr></table>", "01/31/2024")], "h string, d string")
    r = d.select(readers.table_rows(F.col("h")).alias("t"), readers.any_date(F.col("d")).alias("d")).first()
    assert r.t == [["Symbol"], ["BRK.B", "x"]] and str(r.d) == "2024-01-31"


def test_generators_repeat(spark):
    g = generators.XorShift(0)
    assert g.state == 0xDEADBEEF and 0 <= g.uniform() < 1
    u = [generators.Universe(symbols=3, bars=50, seed=5)]
    one, two = (sorted(map(tuple, generators.universes(spark, u).collect())) for _ in range(2))
    assert one == two and len(one) == 150
    z = np.array([generators.XorShift(9).normal() for _ in range(1)] + [x for g in [generators.XorShift(9)] for x in (g.normal() for _ in range(4000))])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.06


def test_estimators_recover_what_was_planted():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + 0.3 * rng.normal(size=600)
    assert estimators.granger(x, y)["p"] < 1e-6 < 0.01 < estimators.granger(y, x)["p"]
    assert estimators.distance_correlation(x, x * x)["dcor"] > 0.4 > estimators.distance_correlation(x, rng.normal(size=600))["dcor"]
    assert estimators.adf(x)["t"] < -5 < -3 < estimators.adf(np.cumsum(x))["t"]
    assert 0.35 < estimators.hurst(x)["hurst"] < 0.7
    assert estimators.ccm(x, x[::-1].copy(), library=10**9)["rho"] == 0.0
    common = rng.normal(size=(200, 1))
    noise = rng.normal(size=(200, 20))
    assert estimators.rmt(noise)["n_above"] <= 1 and estimators.rmt(noise + 5 * common)["p"] < 0.01
    assert [s["regime"] for s in estimators.regime_names(estimators.hmm_fit(np.concatenate([rng.normal(0.5, 0.1, 200), rng.normal(-0.5, 0.1, 200), rng.normal(0, 3, 200)]), 3))].count("Bear") == 1
    t = np.cumsum(rng.exponential(1.0, 400))
    assert estimators.hawkes_fit(t)["branching"] < 0.4
    assert 1.8 < estimators.alpha_stable(rng.normal(size=4000))["alpha"] <= 2.0
    plan, cost = estimators.sinkhorn(np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([[0.0, 1.0], [1.0, 0.0]]))
    assert plan.sum() == pytest.approx(1, abs=1e-6) and cost < 0.01
    p = rng.normal(size=(400, 1))
    chain = np.column_stack([p, p + 0.5 * rng.normal(size=(400, 1)), rng.normal(size=(400, 1))])
    adj, _ = estimators.pc_skeleton(np.corrcoef(chain, rowvar=False), 400)
    assert adj[0, 1] and not adj[0, 2]
    assert len(estimators.spanning_tree(list("abc"), np.corrcoef(chain, rowvar=False))) == 2


def test_hawkes_loglik_is_the_recursion_and_not_row_by_row():
    t = np.sort(np.random.default_rng(8).uniform(0, 700, 400_000))
    r, last, want, n = 0.0, 0.0, 0.0, 0.0
    for x in t.tolist():
        decay = math.exp(-3.0 * (x - last))
        want += -0.4 * (x - last) - 0.5 / 3.0 * (1 - decay) * (n + r)
        r = decay * (n + r)
        want, last, n = want + math.log(0.4 + 0.5 * r), x, 1.0
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += 1
        return count if lines < 100_000 else None

    sys.settrace(count)
    try:
        got = estimators.hawkes_loglik(t, 0.4, 0.5, 3.0)
    finally:
        sys.settrace(None)
    assert got == pytest.approx(want, rel=1e-10) and lines < 10_000


def test_cross_excitation_over_blocks_is_the_estimator(spark):
    rng = np.random.default_rng(9)
    streams = [np.sort(rng.uniform(0.1, 90, n)).round(1) for n in (300, 150, 40)]
    rows = [(float(t), k) for k, s in enumerate(streams) for t in s]
    want = estimators.multivariate_hawkes(streams, 1.0, 5)
    got = excitation.multivariate_hawkes(spark.createDataFrame(rows, "t double, kind int").repartition(3), "t", "kind", 1.0, 5, rows=40)
    for name in ("mu", "branching", "radius", "counts"):
        assert got[name] == pytest.approx(want[name], rel=1e-8, abs=1e-12)


def test_hawkes_fold_is_the_estimator(spark):
    t = np.cumsum(np.random.default_rng(3).exponential(1.0, 80))
    d = spark.createDataFrame([("a", float(v)) for v in t], "k string, t double")
    assert folds.hawkes_loglik(d, ["k"], "t", 0.4, 0.5, 1.5).first().loglik == pytest.approx(estimators.hawkes_loglik(t, 0.4, 0.5, 1.5))


def test_noop_preserves_value_and_bad_strategies_are_contained(spark):
    class Broken(Strategy):
        def on_bar(self, bar, view):
            raise RuntimeError

    sim = Simulator(Broken())
    navs = [sim.on_bar(Bar(k, "AAA", 1, 1, 1, 100.0 + k)) for k in range(50)]
    assert set(navs) == {100_000.0} and sim.crashes == 50
    e = backtests.simulate(close_bars(spark, [100.0] * 30), [("n", "noop", {})])
    assert e.count() == 30 and e.filter("nav <> 100000").count() == 0


@pytest.mark.parametrize("name", sorted(STRATEGIES))
def test_strategies_run_validate_and_reset(name):
    s = STRATEGIES[name]()
    s.validate()
    sim, rng = Simulator(s), random.Random(1)
    price = {"LEFT": 100.0, "RIGHT": 100.0, "SYM0": 50.0, "SYM1": 60.0, "SYM2": 70.0}
    for t in range(250):
        for k in price:
            price[k] *= 1 + rng.gauss(0, 0.002)
            sim.on_bar(Bar(t * 60 * 10**9, k, price[k], price[k], price[k], price[k]))
    assert sim.crashes == 0 and math.isfinite(sim.nav())
    s.reset()


def test_bad_settings_are_refused(spark):
    for name, settings in (("garch_vol_target", {"vol_target": 0.9}), ("hurst_regime", {"window": 8}), ("leadlag_pairs", {"leader": "A", "follower": "A"}), ("kalman_pairs", {"q": 0.0})):
        with pytest.raises(ValueError):
            backtests.simulate(close_bars(spark, [1.0]), [("x", name, settings)])


def test_loss_ladder_flattens():
    class Buyer(Strategy):
        def on_bar(self, bar, view):
            return {bar.symbol: 48.0}

    sim, price = Simulator(Buyer(), cash=100_000.0), 100.0
    sim.on_bar(Bar(0, "AAA", 1, 1, 1, price))
    assert sim.positions["AAA"] == 48
    for k in range(1, 200):
        price *= 0.97
        sim.on_bar(Bar(k, "AAA", 1, 1, 1, price))
    assert sim.level >= 3


def test_walk_forward_uses_the_past_only(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, (320, 3))
    later = r.copy()
    later[300:] *= 5
    runs = []
    for x in (r, later):
        d = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "ts_nanos long, a double, b double, c double")
        runs.append({(q.strategy, q.i): q.ret for q in backtests.walk_forward(d, ["a", "b", "c"], ["equal", "min_variance", "momentum_xs"]).collect()})
    assert len(runs[0]) == 3 * (320 - 252)
    assert all(runs[0][k] == pytest.approx(runs[1][k]) for k in runs[0] if k[1] < 300)
    assert runs[0]["equal", 260] == pytest.approx(r[260].mean())


def test_intraday_pack(spark):
    rows = [("A", "2025-01-15", 570 + k, 100 + k * 10 / 389, 100 + k * 10 / 389, 100 + k * 10 / 389, 100 + k * 10 / 389, 1000.0) for k in range(390)]
    d = spark.createDataFrame(rows, "symbol string, session string, minute int, open double, high double, low double, close double, volume double")
    p = packs.intraday_features(d).first()
    assert p.afternoon_drift > 0 and p.vwap_premium == pytest.approx(110 / 105 - 1, abs=1e-3) and p.opening_range > 0 and p.volume_slope == 0.0


def test_contrarian_and_windows(spark):
    d = spark.createDataFrame([(3.0,), (-3.0,), (0.5,), (None,)], "z double")
    assert [r[0] for r in d.select(packs.contrarian(F.col("z"))).collect()] == [-1, 1, 0, 0]
    assert rolling.rolling_windows(100, 50, 20) == [(0, 50), (20, 70), (40, 90), (50, 100)]


def test_rolling_windows_step_21(spark, sf):
    from tidewater import catalog
    from tidewater.plans import research

    def ends(n: int) -> list[int]:
        e = list(range(252, n + 1, 21))
        return e if not e or e[-1] == n else [*e, n]

    lengths = {r["symbol"]: r["count"] for r in research.log_returns(spark, sf).groupBy("symbol").count().collect()}
    got = {}
    for r in catalog.QUERIES["rolling_criticality"](spark, sf).select("symbol", "window_end").collect():
        got.setdefault(r["symbol"], []).append(r["window_end"])
    assert got and {k: sorted(v) for k, v in got.items()} == {k: ends(n) for k, n in lengths.items() if n >= 252}
    p, names = research.panel(spark, sf)
    x = np.array([list(r) for r in p.orderBy("ts_nanos").select(*names).collect()])
    rows = {r["window_end"]: r for r in catalog.QUERIES["rolling_random_matrix"](spark, sf).collect()}
    assert sorted(rows) == ends(len(x)) and rows
    for e, r in rows.items():
        want = estimators.rmt(x[e - 252 : e])
        assert r["n_above"] == want["n_above"] and abs(r["top"] - want["top"]) < 1e-9 and abs(r["p"] - want["p"]) < 1e-9
