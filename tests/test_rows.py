"""Batches as arrays and as tables give the same answers; boosting on both gives the same trees."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import metrics as M
from tidemark.operators.ensemble import Ensemble, TreeManager, ensemble_of, per_tree_importance
from tidemark.operators.rows import LocalRows, TableRows, rows_of
from tidemark.operators.trainer import BoostParams, boost, frame_bins, _bins

NAMES = ["f0", "a.b", "f2", "few"]


def data(n, seed, binary=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 5, n)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = 2 * x[:, 0] + np.nan_to_num(np.sin(x[:, 1])) + 0.3 * x[:, 3] + rng.normal(0, 0.2, n)
    return x, (y > 0.5).astype(float) if binary else y


def frame(spark, x, y):
    d = pd.DataFrame(x, columns=NAMES).assign(y=y, t=np.arange(len(y)), w=np.linspace(0.5, 2, len(y)))
    return spark.createDataFrame(d).repartition(5)


def both(spark, x, y):
    df = frame(spark, x, y)
    a, b = rows_of(df, NAMES, "y", "w", "t"), rows_of(df, NAMES, "y", "w", "t", limit=0)
    assert isinstance(a, LocalRows) and isinstance(b, TableRows)
    return a, b


@pytest.mark.parametrize("binary", [False, True])
def test_boosting_on_tables_gives_the_same_trees(spark, binary):
    x, y = data(1500, 0, binary)
    a, b = both(spark, x, y)
    params = BoostParams(num_leaves=6, max_bin=32, min_data_in_leaf=10)
    base = Ensemble(tuple(NAMES), (), "binary" if binary else "regression")
    first, second = a.train(base, 3, params), b.train(base, 3, params)
    assert [[n[:2] + n[3:5] for n in t] for t in first.trees] == [[n[:2] + n[3:5] for n in t] for t in second.trees]
    assert np.allclose(first.raw(x), second.raw(x), atol=1e-8)
    more, again = a.train(first, 2, params, bounds=a.bins(params)), b.train(second, 2, params)
    assert np.allclose(more.raw(x), again.raw(x), atol=1e-8) and len(again) == 5
    for p, q in zip(_bins(x, 31), frame_bins(b.df, [f"x{i}" for i in range(4)], 31)):
        assert np.allclose(p, q)


def test_early_stopping_on_tables(spark):
    x, y = data(600, 1)
    a, b = both(spark, x, y)
    held_a, held_b = both(spark, *data(300, 2))
    params, base = BoostParams(num_leaves=8, max_bin=16, min_data_in_leaf=2, learning_rate=1.6), Ensemble(tuple(NAMES))
    first, second = a.train(base, 12, params, held_a, 2), b.train(base, 12, params, held_b, 2)
    assert len(first) == len(second) < 12 and np.allclose(first.raw(x), second.raw(x), atol=1e-8)


@pytest.fixture(scope="module")
def scored(spark):
    x, y = data(800, 3)
    v, z = data(500, 4)
    params = BoostParams(num_leaves=6, max_bin=16)
    good = boost(x, y, np.ones(800), Ensemble(tuple(NAMES)), 6, params)
    bad = boost(v[:200], np.random.default_rng(5).normal(0, 4, 200), np.ones(200), good, 4, params)
    return bad, good, both(spark, v, z), (v, z)


mse = lambda y, p: float(np.mean((y - p) ** 2))


@pytest.mark.parametrize("metric", ["rmse", "mae", mse])
def test_scores_and_removals(scored, metric):
    bad, good, (a, b), (v, z) = scored
    base, scores = a.leave_one_out(bad, metric)
    again, table = b.leave_one_out(bad, metric)
    assert np.allclose([base, *scores], [again, *table], atol=1e-9)
    out = bad.outputs(v)
    assert scores[7] == pytest.approx(M.metric_of(metric, z, out.sum(1) - out[:, 7]) - M.metric_of(metric, z, out.sum(1)))
    assert set(np.argsort(scores)[:3].tolist()) <= {6, 7, 8, 9}
    for min_z in (0.0, 2.0):
        order = list(np.argsort(scores))
        assert list(a.removals(bad, order, metric, min_z)) == [(int(c), bool(x)) for c, x in b.removals(bad, [int(c) for c in order], metric, min_z)]
    assert np.isclose(a.loss(bad, metric), b.loss(bad, metric)) and a.loss(good, metric) < a.loss(bad, metric)
    pair = a.compare(good, bad, metric)
    assert pair is None if callable(metric) else np.allclose(pair, b.compare(good, bad, metric)) and pair[0] < 0


def test_a_callable_chooses_like_the_same_metric(spark, scored):
    bad, _, (a, _), (v, z) = scored
    for rows in (a, frame(spark, v, z)):
        named, called = TreeManager(bad), TreeManager(bad)
        named.score_trees(rows, metric="RMSE")
        called.score_trees(rows, metric=mse)
        assert named.ranking() == called.ranking() and named.select_retirement(np.inf) == called.select_retirement(np.inf)
    removed = bad.keep([t for t in range(10) if t not in set(named.select_retirement(np.inf))])
    assert M.metric_of("rmse", z, removed.raw(v)) <= named.baseline


def test_binary_metrics_are_on_the_scale_of_probabilities(spark):
    x, y = data(700, 6, True)
    params = BoostParams(num_leaves=6, max_bin=16)
    good = boost(x, y, np.ones(700), Ensemble(tuple(NAMES), (), "binary"), 6, params)
    bad = boost(x[:150], 1 - y[:150], np.ones(150), good, 3, params)
    p = lambda raw: 1 / (1 + np.exp(-raw))
    out = bad.outputs(x)
    a, b = both(spark, x, y)
    for metric, f in (("rmse", lambda q: np.sqrt(np.mean((y - q) ** 2))), ("mae", lambda q: np.mean(np.abs(y - q)))):
        want = [f(p(out.sum(1) - out[:, t])) - f(p(out.sum(1))) for t in range(9)]
        assert np.allclose(a.leave_one_out(bad, metric)[1], want) and np.allclose(b.leave_one_out(bad, metric)[1], want)
        assert max(want[6:]) < 0 < want[0]
    for metric in ("log_loss", "ROC_AUC", None):
        m = M.resolve(metric, "binary")
        assert np.allclose(a.leave_one_out(bad, m)[1], b.leave_one_out(bad, m)[1])
    m = TreeManager(bad)
    with pytest.raises(ValueError):
        m.score_trees(frame(spark, x, np.where(y == 1, 5.0, 0.0)), metric="logloss")
    with pytest.raises(ValueError):
        m.score_trees(frame(spark, x, np.zeros(700)), metric="auc")


def test_split_by_time_with_ties(spark):
    x, y = data(300, 7)
    a, b = both(spark, x, y)
    for rows in (a, b):
        head, tail = rows.split(60)
        assert (head.n, tail.n) == (240, 60)
    got = b.split(60)[1].df.select("y").toPandas()["y"]
    assert sorted(got) == sorted(a.split(60)[1].y) == sorted(y[240:])
    tied = frame(spark, x, y).withColumnRenamed("t", "old").selectExpr("*", "0 AS t")
    head, tail = rows_of(tied, NAMES, "y", "w", "t", limit=0).split(60)
    local = rows_of(tied, NAMES, "y", "w", "t").split(60)
    assert (head.n, tail.n) == (240, 60) and sorted(tail.df.toPandas()["y"]) == sorted(local[1].y)


def test_samples_and_windows(spark):
    a, b = both(spark, *data(200, 8))
    assert a.sample(50, 1).n == b.sample(50, 1).n == 50 and a.sample(500, 1) is a
    assert np.array_equal(a.sample(50, 1).y, a.sample(50, 1).y)
    for x in (a, b):
        for other in (a, b):
            joined = x.with_rows([other.sample(50, 2)])
            assert joined.n == 250 and joined.renamed(NAMES).features == NAMES
    assert a.with_rows([]) is a


def test_what_is_an_ensemble(spark, scored):
    bad, *_ = scored
    again = ensemble_of(bad.to_frame(spark))
    assert len(again) == len(bad) and set(again.features) <= set(NAMES)
    assert ensemble_of(type("Model", (), {"ensemble_": bad})()) is bad
    with pytest.raises(TypeError):
        ensemble_of("trees")
    with pytest.raises(NotImplementedError):
        ensemble_of(Ensemble(("a",), (), "multiclass"))
    with pytest.raises(ValueError):
        ensemble_of(Ensemble(("a",), (((False, "a", 0.0, 1, 1, 0.0, 0.0, False), (True, None, 0.0, 0, 0, 0.0, 1.0, False)),)))
    totals = per_tree_importance(bad.to_frame(spark)).groupBy("feature").sum("gain", "splits").collect()
    assert {r[0]: r[1] for r in totals} == pytest.approx({f: v for f, v in bad.importance().items() if v})
    constant = boost(np.random.default_rng(0).normal(size=(50, 4)), np.full(50, 2.0), np.ones(50), Ensemble(tuple(NAMES)), 3, BoostParams())
    assert [len(t) for t in constant.trees] == [1, 1, 1] and sum(constant.importance().values()) == 0
