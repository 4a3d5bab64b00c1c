import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import importance as I
from tidemark.operators.ensemble import DriftWarning, Ensemble, TreeManager
from tidemark.operators.model import IncrementalBooster
from tidemark.operators.trainer import BoostParams, boost


def data(n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 0] += shift
    y = 2 * x[:, 0] + np.sin(2 * x[:, 1]) + 0.5 * x[:, 2] + rng.normal(0, 0.1, n)
    return x, y


def frame(spark, x, y):
    d = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    d["y"], d["t"] = y, np.arange(len(y))
    return spark.createDataFrame(d)


NAMES = ("f0", "f1", "f2", "f3")


@pytest.fixture(scope="module")
def poisoned():
    x, y = data(2000, 0)
    e = boost(x, y, np.ones(2000), Ensemble(NAMES), 20, BoostParams(num_leaves=8))
    nx, _ = data(500, 1)
    bad = boost(nx, e.raw(nx) + np.random.default_rng(2).normal(0, 5, 500), np.ones(500), e, 4, BoostParams(num_leaves=8, learning_rate=0.5))
    return e, bad


def test_boosting_learns():
    x, y = data(2000, 3)
    losses = [np.mean((boost(x, y, np.ones(2000), Ensemble(NAMES), k, BoostParams(num_leaves=8)).raw(x) - y) ** 2) for k in (1, 10, 40)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.2 * np.var(y)


def test_loo_is_exact_and_finds_poison(spark, poisoned):
    clean, bad = poisoned
    x, y = data(1000, 4)
    m = TreeManager(bad)
    scores = m.score_trees(frame(spark, x, y))
    out = bad.outputs(x)
    rmse = lambda r: np.sqrt(np.mean((r - y) ** 2))
    assert np.allclose(scores, [rmse(out.sum(1) - out[:, t]) - rmse(out.sum(1)) for t in range(24)], atol=1e-9)
    gone = m.select_retirement(min_z=2.0)
    assert gone and set(gone) <= set(m.identify_retiring()) and any(t >= 20 for t in gone)
    left = m.retire_trees(gone)
    assert len(bad) == 24 and rmse(left.raw(x)) < rmse(bad.raw(x))
    with pytest.raises(ValueError):
        m.retire_trees([0, 0])
    with pytest.warns(DriftWarning):
        assert len(m.retire_trees(list(range(20)))) == 12
    assert Ensemble.from_frame(bad.to_frame(spark), list(NAMES)).raw(x) == pytest.approx(bad.raw(x))


def test_clusters_stability_and_tau(spark):
    rng = np.random.default_rng(5)
    s = rng.normal(size=(1500, 2))
    x = np.column_stack([s[:, 0], s[:, 0] + 0.1 * rng.normal(size=1500), s[:, 1], np.ones(1500)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES)).withColumn("f1", F.when(F.col("f1") < 2, F.col("f1")))
    corr = I.ClusteredImportance().correlation(df)
    d = df.toPandas()
    assert np.allclose(corr[:3, :3], d.iloc[:, :3].corr("spearman"), atol=1e-9) and corr[0, 3] == 0
    assert I.cluster(corr, list(NAMES)) == {0: ["f0", "f1"], 1: ["f2"], 2: ["f3"]}
    assert I.stability(spark, np.array([[3.0, 2, 1], [3, 2, 1]])) == ([1.0, 1.0, 1.0], 1.0)
    assert I.stability(spark, np.array([[3.0, 2, 1], [1, 2, 3]])) == ([-1.0, -1.0, -1.0], -1.0)
    mi = I.ClusteredImportance("mutual_info").correlation(df.select("f0", "f2", (F.col("f0") ** 2).alias("q")))
    assert mi[0, 2] > 0.8 > 0.3 > mi[0, 1]


def test_model_follows_drift_and_round_trips(spark, tmp_path):
    m = IncrementalBooster(n_estimators_per_batch=8, num_leaves=8, n_bins=32, max_stored_batches=2)
    m.fit(frame(spark, *data(800, 6)), features=list(NAMES), order="t")
    m.partial_fit(frame(spark, *data(800, 7)), features=list(NAMES), order="t")
    later = frame(spark, *data(800, 8, shift=4.0))
    m.set_params(drift_fraction=0.2)
    stale = m.score(later)
    m.tracker_.params["drift_fraction"] = 0.2
    m.partial_fit(later, features=list(NAMES), order="t", eval_set=frame(spark, *data(300, 9, shift=4.0)))
    h = m.history_
    assert [r["stage"] for r in h] == ["fit", "partial_fit", "partial_fit"]
    assert h[2]["rebin_triggered"] and h[2]["drifted_features"] == ["f0"] and h[2]["val_loss_after"] < h[2]["val_loss_before"]
    assert m.history(spark).count() == 3 and m.score(later) > stale + 1
    m.save(spark, str(tmp_path / "m"))
    again = IncrementalBooster.load(spark, str(tmp_path / "m"))
    a, b = (k.predict(later.limit(50)).select("prediction").collect() for k in (m, again))
    assert a == b
    report = m.feature_importance_report(later, "y")
    assert report.permutation[report.cluster_of("f0")] > 0 and abs(sum(map(report.cluster_share, report.clusters)) - 1) < 1e-9


def test_classes_and_errors(spark):
    x, y = data(600, 10)
    df = frame(spark, x, y).withColumn("y", F.when(F.col("y") > 0, "up").otherwise("down"))
    m = IncrementalBooster(task="classification", n_estimators_per_batch=8, num_leaves=6, n_bins=16).fit(df, features=list(NAMES), order="t")
    assert m.score(df) > 0.85 and m.classes_ == ["down", "up"]
    with pytest.raises(ValueError):
        m.partial_fit(df.withColumn("y", F.lit("flat")), features=list(NAMES), order="t")
    with pytest.raises(RuntimeError):
        IncrementalBooster().predict(df)
    with pytest.raises(ValueError):
        IncrementalBooster(num_boost_round=3)
    for wrong in ({"task": "ranking"}, {"n_estimators_per_batch": 200, "max_total_trees": 100}, {"drift_threshold": 0.0}, {"task": "classification", "objective": "regression"}, {"validation_fraction": 1.0}, {"drift_fraction": 1.0}, {"objective": "binary"}, {"scoring_metric": "nonsense"}):
        with pytest.raises(ValueError):
            IncrementalBooster(**wrong).fit(df, features=list(NAMES))
    with pytest.raises(NotImplementedError):
        IncrementalBooster(task="classification").fit(df.withColumn("y", F.col("t") % 3), features=list(NAMES))
