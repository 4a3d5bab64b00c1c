"""Small cases of each operator against brute force: nulls, empty and odd texts, repeated rows, clashing names, empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, suffix_dedup
from tidemark.llm.common import running_total

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _uid long, size string, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None, 1, "x", "y") for i, t, l, s in rows], DOCS)


def some(seed=0, n=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"] + [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90))), "en", rng.choice(["a", "b", "c", None])) for i in range(n)]
    for i in range(0, 30, 3):
        t = rows[i][1].split()
        t[len(t) // 2] = "changed"
        rows.append((1000 + i, " ".join(t), "en", "a"))
        rows.append((2000 + i, rows[i][1].replace(" ", "\n\t"), "en", "b"))
    return rows + [(5000, None, None, None), (5001, "", "en", "a"), (None, "no id", "en", "c"), (7, rows[7][1], "en", "a"), (5002, "€\U0001f600 " * 900, "en", "c"), (5003, "[x] <y> \\e", "en", "c")]


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, some()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_suffix_dedup(spark, table, none, monkeypatch):
    L = 40
    texts = [(i, (t or "").encode()) for i, t, _, _ in some()]
    seen = collections.Counter(t[k : k + L] for _, t in texts for k in range(len(t) - L + 1))
    want = []
    for i, t in texts:
        m = bytearray(len(t))
        for k in range(len(t) - L + 1):
            if seen[t[k : k + L]] > 1:
                m[k : k + L] = b"\1" * L
        want.append((i, len(t), sum(m), len([s for s in bytes(m).split(b"\0") if s]), hashlib.sha256(bytes(b for b, x in zip(t, m) if not x)).hexdigest()))
    for wide, batch in ((2048, 1 << 20), (1, 1 << 20), (2048, 700)):  # 700: long texts are read in overlapping parts
        monkeypatch.setattr(suffix_dedup, "WIDE", wide)
        monkeypatch.setattr(suffix_dedup, "BATCH", batch)
        got = [tuple(r) for r in suffix_dedup.remove_repeats(table, L).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_language_id(spark, none):
    rows = [(i, "the cat sat on the mat and then the dog ran", "en", "a") for i in range(30)] + [(100 + i, "der hund und die katze sind nicht im haus", "de", "a") for i in range(30)]
    model = language_id.fit(docs(spark, rows))
    asked = docs(spark, [(1, "the dog and the mat", None, None), (2, "die katze und der hund", None, None), (3, None, None, None), (4, "123 !", "en", None), (5, "", None, None), (6, "x" * 20000, None, None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0) and 0 <= got[6][1] <= 1
    assert language_id.identify(none, model).count() == 0 and language_id.fit(none) == ([], [], {})


def test_running_total(spark):
    df = spark.createDataFrame([(i % 2, i, i) for i in range(50)] + [(None, 7, 100)], "k long, o long, w long")
    rows = running_total(df, ["k"], "o", "w", 8, "w").collect()
    for k in (0, 1, None):
        mine = sorted((r.position, r.w) for r in rows if r.k == k)
        assert [p for p, _ in mine] == [sum(w for _, w in mine[:i]) for i in range(len(mine))]
