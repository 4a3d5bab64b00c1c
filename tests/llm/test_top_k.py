"""Best rows against all scores, over several blocks and chunks, ties, repeated ids, and odd vectors."""

import numpy as np
import pytest

from tidemark.llm import top_k

SCHEMA = "vec_id long, embedding array<double>, score long, `a.b` int, block int, uid long"


def vectors(n=150, dims=6, seed=0):
    rng = np.random.default_rng(seed)
    v = [(i, [float(x) for x in rng.normal(size=dims).round(1)]) for i in range(n)]
    return v + [(150, None), (151, [1.0, None] + [0.0] * (dims - 2)), (152, [float("nan")] * dims), (153, [float("inf")] + [0.0] * (dims - 1)), (None, [1.0] * dims), (154, []), (100, [0.5] * dims), (0, v[0][1]), (0, v[0][1]), (155, [1.0, 2.0]), (200, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, 3, 4) for i, x in rows], SCHEMA)


def brute(rows, every, k=10):
    good = [(i, [int(np.floor(c * 1024)) for c in x]) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()]
    want = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, q)), j) for m, (j, x) in enumerate(good) if m != n and len(x) == len(q))[:k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("block, chunk", [(8192, 1024), (40, 2)])
def test_matches_all_scores(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "CHUNK", chunk)
    rows = vectors()
    assert sorted(map(tuple, top_k.exact_top_k(frame(spark, rows), every=50).collect())) == brute(rows, 50)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e14 + i, -1e14, 3.0 * i]) for i in range(30)]
    assert sorted(map(tuple, top_k.exact_top_k(frame(spark, rows), every=10).collect())) == sorted([(a, b, c, max(-(1 << 63), min((1 << 63) - 1, d))) for a, b, c, d in brute(rows, 10)])


def test_bound_stops_before_the_end():
    """On vectors that differ in one strong dimension the search ends after few rows, with the same answer."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(2000, 4)) * [10_000, 1, 1, 1])
    q = np.array([900.0, 1, 0, -1])
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, rows):
            if isinstance(rows, np.ndarray) and rows.ndim == 1:
                seen.append(len(rows))
            return np.ndarray.__getitem__(self, rows)

    ids = np.arange(2000)
    got = top_k.threshold_top_k(np.argsort(x, axis=0, kind="stable"), x.view(Watched), ids, ids, q, -1, 5)
    assert [r[1] for r in got] == sorted(range(2000), key=lambda i: (-(x[i] @ q), i))[:5] and sum(seen) < 1000


def test_empty_table(spark):
    assert top_k.exact_top_k(frame(spark, [])).count() == 0 and top_k.exact_top_k(frame(spark, [(100, [1.0])])).count() == 0
