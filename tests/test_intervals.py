import numpy as np


def test_bca_without_bias_is_percentile():
    from assaygrid.operators.intervals import bca_limits

    x = np.random.default_rng(3).normal(size=999)
    low, high = bca_limits(x, 0.5, 0.0)
    assert np.allclose([low, high], np.quantile(x, [0.025, 0.975]))
    up = bca_limits(x, 0.6, 0.0)
    assert up[0] > low and up[1] > high
    assert bca_limits(np.ones(50), 0.5, 0.0) == (1.0, 1.0)


def test_bca_of_families(spark):
    from assaygrid.plans.engine import QUERIES

    rows = QUERIES["effect_ci_bca"](spark, "/root/testdata/sf0.001").collect()
    plain = {r.family: r for r in QUERIES["effect_ci_percentile"](spark, "/root/testdata/sf0.001").collect()}
    assert {r.family for r in rows} == set(plain)
    for r in rows:
        assert (r.status == "ESTIMATED") == (r.ci_low is not None)
        if r.ci_low is not None:
            assert r.ci_low <= r.ci_high and r.ci_low <= plain[r.family].ci_high and r.ci_high >= plain[r.family].ci_low
