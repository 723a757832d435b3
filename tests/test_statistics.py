"""Special functions, lag regressions, scaling exponents and distance correlation against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalar, special
from tidewater.operators import estimators, regressions, scaling


def test_tails_in_the_jvm(spark):
    d = spark.createDataFrame([(x,) for x in (-30.0, -2.5, -0.4, 0.0, 1.0, 2.4999, 2.5, 4.0, 26.0, None)], "x double")
    for r in d.select("x", special.erfc(F.col("x")).alias("e")).collect():
        assert r.e is None if r.x is None else r.e == pytest.approx(math.erfc(r.x), rel=1e-11)
    d = spark.createDataFrame([(f, a, b) for f in (0.0, 0.3, 2.0, 40.0) for a in (1, 2, 7) for b in (1, 4, 900)], "f double, a int, b int")
    for r in d.select("f", "a", "b", special.f_upper(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(scalar.f_tail(r.f, r.a, r.b), rel=1e-9, abs=1e-14)


def pair_rows(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 3)
    y = np.concatenate([[0.0], 0.6 * x[:-1]]) + 0.5 * rng.normal(size=n)
    return x, y, [("p", "q", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [("p", "r", k, float(k % 3), float(k)) for k in range(3)]


PAIRS = "a string, b string, ts_nanos long, x double, y double"


@pytest.mark.parametrize("lags", [1, 3])
def test_granger_and_dickey_fuller(spark, lags):
    x, y, rows = pair_rows()
    d = spark.createDataFrame(rows, PAIRS).repartition(3)
    got = {r.b: r for r in regressions.granger(d, ["a", "b"], "ts_nanos", "x", "y", lags).collect()}
    want = estimators.granger(x, y, lags)
    assert got["q"].f == pytest.approx(want["f"], rel=1e-9) and got["q"].p == pytest.approx(want["p"], rel=1e-6, abs=1e-12)
    assert (got["r"].f, got["r"].p) == (0.0, 1.0)
    told = {r.b: r for r in regressions.dickey_fuller(d, ["a", "b"], "ts_nanos", "y", lags).collect()}
    assert told["q"].t == pytest.approx(estimators.adf(y, lags)["t"], rel=1e-9) and told["r"].t == 0.0


def test_granger_of_lags_that_explain_each_other(spark):
    d = spark.createDataFrame([("p", "q", k, float(k), float(k)) for k in range(60)], PAIRS)
    r = regressions.granger(d, ["a", "b"], "ts_nanos", "x", "y", 2).first()
    assert r.f >= 0 and 0 <= r.p <= 1


def test_scaling(spark):
    rng = np.random.default_rng(4)
    series = {"noise": rng.normal(size=700), "walk": np.cumsum(rng.normal(size=333)), "short": rng.normal(size=20), "flat": np.ones(100)}
    d = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, t long, v double")
    hurst = {r.k: r.hurst for r in scaling.rescaled_range(d, ["k"], "t", "v").collect()}
    for k, x in series.items():
        want = estimators.hurst(x)["hurst"]
        assert hurst[k] == (None if want is None else pytest.approx(want, abs=1e-9))
    spectrum = {r.k: r for r in scaling.spectrum(d.filter("k IN ('noise', 'walk')"), ["k"], "t", "v").collect()}
    for k in ("noise", "walk"):
        want = estimators.mfdfa(series[k])
        assert (spectrum[k].h2, spectrum[k].width) == pytest.approx((want["h2"], want["width"]), abs=1e-6)


def test_distance_correlation(spark):
    x, y, rows = pair_rows(5, 150)
    rows += [("f", "g", k, 1.0, float(k)) for k in range(9)] + [("t", "u", k, float(k % 4), float(k % 3)) for k in range(50)]
    got = {r.a + r.b: r.dcor for r in scaling.distance_correlation(spark.createDataFrame(rows, PAIRS).repartition(3)).collect()}
    ties = np.arange(50.0)
    assert got["pq"] == pytest.approx(estimators.distance_correlation(x, y)["dcor"], abs=1e-9)
    assert got["tu"] == pytest.approx(estimators.distance_correlation(ties % 4, ties % 3)["dcor"], abs=1e-9)
    assert got["pr"] == got["fg"] == 0.0


def test_distance_correlation_of_many_rows(spark):
    """20,000 rows a pair: far beyond what all pairs of rows would allow."""
    d = spark.range(20_000).selectExpr("'p' AS a", "'q' AS b", "id AS ts_nanos", "double(hash(id) % 1000) AS x", "double(hash(id) % 1000) * double(hash(id) % 1000) AS y")
    assert 0.2 < scaling.distance_correlation(d).first().dcor < 0.8
