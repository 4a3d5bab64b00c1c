"""Order statistics by narrowing brackets, and running sums by ranges, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.ranges import running_before
from tidemark.operators import drift as D


def columns(n, seed=0):
    rng = np.random.default_rng(seed)
    heavy = np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n))  # one value holds most rows
    return {"normal": rng.normal(size=n), "few": rng.integers(0, 4, n).astype(float), "heavy": heavy, "wide": np.exp(20 * rng.normal(size=n)), "constant": np.full(n, 3.0), "a.b": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n))}


@pytest.mark.parametrize("limit", [50, 400, 10**6])
def test_order_statistics(spark, limit):
    x = columns(20_000)
    df = spark.createDataFrame(pd.DataFrame(x)).repartition(5)
    sorted_ = {f: np.sort(v[~np.isnan(v)]) for f, v in x.items()}
    rng = np.random.default_rng(1)
    ranks = {f: sorted({0, len(v) - 1, *rng.integers(0, len(v), 9).tolist()}) for f, v in sorted_.items()}
    got = D.order_statistics(df, ranks, limit)
    assert got == {f: {r: sorted_[f][r] for r in rs} for f, rs in ranks.items()}


@pytest.mark.parametrize("collected", [1 << 21, 0])
def test_reference_by_either_way(spark, monkeypatch, collected):
    monkeypatch.setattr(D, "COLLECTED", collected)
    x = columns(3000)
    t = D.DistributionTracker(n_bins=16).fit(spark.createDataFrame(pd.DataFrame(x)))
    for f, v in x.items():
        v = v[~np.isnan(v)]
        r = t.reference[f]
        assert r["quantiles"] == pytest.approx(np.quantile(v, np.linspace(0, 1, 17)).tolist(), rel=1e-12)
        e = np.array(r["edges"])
        assert r["below"] == [int((v < k).sum()) for k in e] and r["upto"] == [int((v <= k).sum()) for k in e]
        assert (r["count"], r["missing"], r["min"], r["max"]) == (len(v), 3000 - len(v), v.min(), v.max())
        assert r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(), rel=1e-9, abs=1e-12)
        assert sum(r["histogram"]) == len(v)


def test_running_sums(spark):
    x = columns(4000, 2)
    df = spark.createDataFrame(pd.DataFrame({"v": x["normal"], "g": x["few"]}))
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in running_before(counts, ["g"], "v", "n").collect():
        assert r.before == int(((x["few"] == r.g) & (x["normal"] < r.v)).sum())
    few = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert [r.before for r in running_before(few, [], "g", "n").orderBy("g").collect()] == [int((x["few"] < k).sum()) for k in range(4)]


def test_auc(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.normal(size=3000), 1), rng.integers(0, 2, 3000).astype(float)
    ranks = pd.Series(s).rank().to_numpy()
    n = y.sum()
    want = (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (3000 - n))
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    assert M.auc(df, "y", "s").first()["auc"] == pytest.approx(want) and M.auc_of(y, s) == pytest.approx(want)
    assert M.auc(df.where("y = 1"), "y", "s").first()["auc"] is None and M.auc_of(np.ones(3), np.arange(3.0)) is None
