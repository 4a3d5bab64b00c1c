import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.drift import DistributionTracker, kolmogorov


def frame(spark, x, names=None):
    return spark.createDataFrame(pd.DataFrame(x, columns=names or [f"f{i}" for i in range(x.shape[1])]))


def test_shifted_features_in_order(spark):
    rng = np.random.default_rng(0)
    t = DistributionTracker(n_bins=32)
    t.update(frame(spark, rng.normal(size=(2000, 6))))
    moved = rng.normal(size=(2000, 6))
    moved[:, 1] += 0.5
    moved[:, 4] += 1.0
    report = t.update(frame(spark, moved))
    assert report.drifted == ["f4", "f1"] and report.needs_rebin


def test_digest_is_exact(spark):
    x = np.random.default_rng(1).normal(size=(777, 1))
    t = DistributionTracker(n_bins=16).fit(frame(spark, x))
    assert np.allclose(t.reference["f0"]["quantiles"], np.quantile(x, np.linspace(0, 1, 17)), atol=1e-12)
    assert sum(t.reference_histogram("f0")[1]) == 777


def test_missing_and_constant(spark):
    x = np.column_stack([np.full(600, 5.0), np.full(600, np.nan), np.arange(600.0)])
    t = DistributionTracker(n_bins=8)
    t.update(frame(spark, x))
    y = x.copy()
    y[:, 0], y[0, 2] = 4.0, np.inf
    r = {q["feature"]: q for q in t.update(frame(spark, y)).rows}
    assert r["f0"]["ks_statistic"] == 1.0 and r["f0"]["mean_shift"] == -math.inf and r["f0"]["out_of_range_fraction"] == 1.0
    assert r["f1"]["p_value"] == 1.0 and not r["f1"]["drifted"]
    assert t.running["f1"]["missing"] == 1200 and t.running["f2"]["missing"] == 1


def test_reset_keeps_the_last_report_and_state_round_trips(spark, tmp_path):
    rng = np.random.default_rng(2)
    t = DistributionTracker(n_bins=8)
    t.update(frame(spark, rng.normal(size=(600, 2))))
    t.update(frame(spark, rng.normal(3, 1, size=(600, 2))))
    t.reset(frame(spark, rng.normal(3, 1, size=(600, 2))))
    assert t.should_rebin() and t.n_batches_seen == 2
    t.save(spark, str(tmp_path / "t"))
    again, batch = DistributionTracker.load(spark, str(tmp_path / "t")), frame(spark, rng.normal(3, 1, size=(400, 2)))
    assert again.update(batch).rows == t.update(batch).rows


def test_errors(spark):
    with pytest.raises(ValueError):
        DistributionTracker(n_bins=1)
    with pytest.raises(RuntimeError):
        DistributionTracker().feature_stats("x")
    with pytest.raises(TypeError):
        DistributionTracker().fit(spark.createDataFrame([("a",)], "x string"))
    with pytest.raises(ValueError):
        DistributionTracker().fit(spark.createDataFrame([], "x double"))
    t = DistributionTracker(n_bins=4).fit(spark.createDataFrame([(1.0,), (2.0,)], "x double"))
    with pytest.raises(KeyError):
        t.feature_stats("y")
    assert t.effective_threshold(50) == 0.1 and t.effective_threshold(5000) == 0.01


def test_kolmogorov():
    assert kolmogorov(0.0) == 1.0 and abs(kolmogorov(1.36) - 0.0495) < 1e-3
