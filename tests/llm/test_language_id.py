"""The lattice against all segmentations one by one, and accuracy on documents the fit has not seen."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, queries
from tidemark.llm.language_id import UNKNOWN, Lattice, Scorer, learn_pieces


def segmentations(word, pieces):
    """Every way to cut the word into pieces and letters that are no piece."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def some(seed):
    rng = random.Random(seed)
    letters = "ab\u00e9\U00010400\u2581"
    pieces = {"".join(rng.choices(letters, k=rng.randint(1, 4))): (rng.random(), rng.random()) for _ in range(25)}
    words = list({"".join(rng.choices(letters[:4], k=rng.randint(1, 9))) for _ in range(40)})
    return pieces, words


@pytest.mark.parametrize("seed", range(5))
def test_forward_sums_all_segmentations(seed):
    pieces, words = some(seed)
    got = Scorer(["x", "y"], [0.0, 0.0], pieces).words(words)
    for w, row in zip(words, got):
        for k in range(2):
            mass = sum(math.prod(pieces[p][k] if p in pieces else UNKNOWN for p in cut) for cut in segmentations("\u2581" + w, pieces))
            assert row[k] == pytest.approx(math.log(mass), abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_expected_counts(seed):
    pieces, words = some(seed)
    names, n = list(pieces), np.arange(1.0, len(words) + 1)
    probs = np.array([p[0] for p in pieces.values()])
    want = dict.fromkeys(names, 0.0)
    for w, times in zip(words, n):
        cuts = [(math.prod(pieces[p][0] if p in pieces else UNKNOWN for p in cut), cut) for cut in segmentations("\u2581" + w, pieces)]
        for mass, cut in cuts:
            for p in cut:
                if p in pieces:
                    want[p] += times * mass / sum(m for m, _ in cuts)
    assert Lattice(names).expected(words, n, probs) == pytest.approx([want[p] for p in names], rel=1e-9)


def test_expectation_maximisation_raises_the_likelihood():
    pieces, words = some(9)
    lattice, n = Lattice(list(pieces)), np.ones(len(words))
    mass = lambda probs: lattice.scores(words, np.concatenate([probs, [UNKNOWN, 0.0]])[:, None]).sum()
    found = [mass(learn_pieces(words, n, lattice, k)) for k in (0, 1, 4)]
    assert found[0] < found[1] <= found[2] + 1e-6


def test_very_long_words_and_texts():
    scorer = Scorer(["x", "y"], [0.0, 0.0], {"\u2581": (0.5, 0.5), "a": (1e-6, 1e-5), "aa": (1e-7, 1e-7)})
    got = scorer.words(["a" * 5000])[0]
    assert np.isfinite(got).all() and got[1] > got[0]
    assert scorer.texts(["a" * 5000 + " a", "a " * 400_000, None, "", "12 !"])[2:] == [("und", 0.0)] * 3
    assert [x[0] for x in scorer.texts(["a" * 5000, "a " * 400_000])] == ["y", "y"]


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n >= 30 and right >= 0.95 * n


def test_repeated_rows_ties_and_clashing_names(spark):
    rows = [(i, t, lang, 0.5) for i, t, lang in [(1, "so so", "b"), (1, "so so", "b"), (2, "so so", "a"), (3, None, "a"), (4, "so", None)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language_id.fit(df, ["\u2581so", "s", "o", "\u2581"])
    assert model[0] == ["a", "b"]
    with pytest.raises(ValueError):
        language_id.identify(df, model)
    got = language_id.identify(df, model, names=("found", "how sure")).collect()
    assert [r.found for r in got if r.doc_id == 1] == ["b", "b"] and len(got) == 5 and {r.score for r in got} == {0.5}
    assert [r.found for r in got if r.doc_id == 3] == ["und"]
    tied = (["a", "b"], [0.0, 0.0], {"s": (0.5, 0.5)})
    assert language_id.identify(df, tied, names=("found", "sure")).where("doc_id = 1").first().found == "a"
