"""Every registered query of the engine against its SQL, and the flagship entry."""

import pytest

from tests.oracle import same
from tidewater import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE_SQL[name], sf)


# what holds for every row of the queries without SQL: (rows at least, condition)
HOLDS = {
    "causal_graph": (0, "a <> b AND directed IS NOT NULL"),
    "covariance_lift": (1, "sample_vol > 0 AND rie_vol > 0 AND abs(lift - (sample_vol - rie_vol) / sample_vol) < 1e-6 AND fires = (lift > 0.005)"),
    "cross_excitation": (25, "branching BETWEEN 0 AND 10 AND radius < 1"),
    "cross_map_convergence": (30, "dim IN (2, 3, 4) AND rho BETWEEN -1 AND 1 AND convergence BETWEEN -1 AND 1"),
    "cross_map_skill": (10, "a < b AND rho BETWEEN -1 AND 1"),
    "diffusion_coordinates": (50, "abs(u) < 10 AND abs(v) < 10"),
    "echo_state_fit": (10, "corr BETWEEN -1 AND 1 AND mse > 0"),
    "event_walk_forward": (1, "events > 0 AND nav > 0 AND fills >= 0"),
    "garch_fits": (5, "omega > 0 AND alpha >= 0 AND beta >= 0 AND alpha + beta < 1"),
    "hawkes_fits": (5, "mu > 0 AND branching >= 0 AND branching < 1 AND abs(branching - alpha / beta) < 1e-9 AND abs(half_life - ln(2) / beta) < 1e-9"),
    "markov_fits": (15, "state IN (0, 1, 2) AND variance >= 0 AND stay BETWEEN 0 AND 1 AND share BETWEEN 0 AND 1 AND regime IN ('Bear', 'Bull', 'Sideways')"),
    "monte_carlo_regimes": (1, "paths = 20000 AND p05 < mean AND mean < p95 AND below_one BETWEEN 0 AND 1"),
    "rolling_criticality": (5, "branching >= 0 AND branching < 1 AND coalesce(width, 0) >= 0 AND tail > 0 AND tail <= 2"),
    "rolling_random_matrix": (1, "n_above BETWEEN 0 AND 5 AND top >= 1 AND edge > 1 AND top_share BETWEEN 0.2 AND 1 AND p BETWEEN 0 AND 1"),
    "stable_fits": (5, "alpha > 0 AND alpha <= 2 AND beta BETWEEN -1 AND 1 AND gamma > 0"),
    "strategy_backtests": (9, "n_periods > 0 AND nav > 0 AND max_drawdown BETWEEN 0 AND 1 AND (run <> 'noop' OR (nav = 100000 AND fills = 0))"),
    "symbolic_signal": (1, "length(expression) > 0 AND depth >= 1"),
    "synthetic_universes": (1, "low <= least(open, close) AND high >= greatest(open, close) AND low > 0"),
    "tail_risk_gap": (5, "abs(gaussian) > 0 AND abs(stable) > 0"),
    "topology_windows": (1, "n > 0 AND longest > 0 AND l2 <= l1 + 1e-9"),
    "transport_blend": (5, "weight BETWEEN 0 AND 1"),
    "transport_distance": (10, "cost >= 0 AND cost <= 1"),
    "wavelet_coherence": (40, "scale IN (4, 8, 16, 32) AND coherence BETWEEN 0 AND 1.000001"),
    "weight_walk_forward": (9, "sharpe IS NOT NULL"),
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf).cache()
    least, holds = HOLDS[name]
    assert df.count() >= least and not df.filter(f"NOT coalesce({holds}, false)").head(3)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
