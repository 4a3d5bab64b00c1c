"""The mix against a line of words laid out, repeated and cut in plain Python; the schedule and its order."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid long, size string, `a.b` string"
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None, 1, "x", "y") for i, t, l, s in rows], SCHEMA)


def some(seed=0, n=150):
    rng = random.Random(seed)
    rows = [(i, " \n".join(rng.choices(["a", "bb", "\u00a0c"], k=rng.choice([0, 1, 5, 40, 300]))), "en", rng.choice(["a", "a", "a", "b", "c", "\U0001f600", "z", None])) for i in range(n)]
    return rows + [(5000, None, "en", None), (5001, "", "en", "only empty"), (None, "no id", "en", "c"), (7, "twice so", "en", "a"), (7, "twice so", "en", "a"), (6000, "w " * 3000, "en", "b")]


def level(sizes, weights):
    """Targets one source after the other: give out by weight until nobody is above three times its size."""
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}
    while open_:
        w = sum(weights[i] for i in sorted(open_))
        over = [i for i in open_ if total / w * weights[i] > 3 * sizes[i]]
        for i in over:
            target[i] = 3.0 * sizes[i]
        if not over:
            for i in open_:
                target[i] = total / w * weights[i]
            break
        total -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("slots", [1 << 17, 64])
def test_taken_words_match_the_line(spark, monkeypatch, slots):
    rows = some()
    df = docs(spark, rows)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = lambda t: len(TOKEN.findall(t or ""))
    sizes = [sum(size(t) for _, t, _, s in rows if s == name) for name in names]
    targets = level(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = []
    for name, n, target in zip(names, sizes, targets):
        # The hash order of running_total: by the unsigned upper half, then the signed whole.
        mine = sorted((r for r in rows if r[3] == name), key=lambda r: ((hashes[r[0]] >> 32) & 0xFFFFFFFF, hashes[r[0]]))
        left = round(target)
        taken = collections.Counter()
        for _ in range(3):
            for k, r in enumerate(mine):
                taken[k] += (got := min(left, size(r[1])))
                left -= got
        want += [(r[0], size(r[1]), n, round(target, 6), taken[k]) for k, r in enumerate(mine)]
    taken, staged, _ = mixing.mix(df.select("doc_id", "text", "source"), slots)
    got = staged.join(taken, F.col("_uid") == F.col("_u")).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("cut")).alias("taken")).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key((a, b, c, round(d, 6), e)) for a, b, c, d, e in got) == sorted(map(key, want))
    assert sum(w[4] for w in want) == pytest.approx(sum(sizes), abs=len(names))


def test_whole_documents_and_columns(spark):
    df = docs(spark, some())
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and {(r._uid, r["size"], r["a.b"]) for r in mixed.collect()} == {(1, "x", "y")}
    taken = mixing.mix_counts(df).agg(F.sum("taken")).first()[0]
    assert sum(len(TOKEN.findall(r.text or "")) for r in mixed.collect()) == taken
    texts = {(r[0], r[1]) for r in some()}
    assert all((r.doc_id, r.text) in texts for r in mixing.mixed_documents(df, whole=True).collect())


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_counts(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0
    none = mixing.mix_counts(docs(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r["size"], r.taken, r.target) for r in none] == [(0, 0, 0.0)] * 2
    assert mixing.water_level([10, 100, 100], [5, 1, 1]) == [30.0, 90.0, 90.0]


def test_slots_are_spread_evenly(spark):
    """Any stretch of the schedule holds each source near its share."""
    blocks = [500, 300, 199, 1]
    plan = [r.source_no for r in sorted(mixing.schedule(spark, blocks).collect())]
    for k, n in enumerate(blocks):
        for a in range(0, 900, 37):
            assert abs(sum(s == k for s in plan[a : a + 100]) - n / 10) <= 2 + math.log2(100)


def test_mixing_meets_targets_below_a_block(spark):
    rows = [(i, "w " * (2000 if i < 4 else 3), "en", f"s{min(i, 4) + (i > 4) * (i - 4):02}") for i in range(40)]
    taken, staged, _ = mixing.mix(docs(spark, rows), slots=16)
    got = collections.Counter()
    for r in taken.join(staged, F.col("_u") == F.col("_uid")).select("row.source", "size", "target", "copies", "cut").collect():
        got[r.source, r.target] += r.copies * r["size"] + r.cut
    assert len(got) == 40 and all(n == round(target) > 0 for (_, target), n in got.items())
    plan = sorted(mixing.schedule(spark, [5, 0, 1, 30]).collect())
    assert [r.slot for r in plan] == list(range(36)) and collections.Counter(r.source_no for r in plan) == {0: 5, 2: 1, 3: 30}


def test_mixed_rows_follow_the_schedule(spark):
    source = {i: "ab"[i >= 20] for i in range(40)}
    rows = [(i, f"w{i}  x y", "en", source[i]) for i in source]
    plan = [r.source_no for r in sorted(mixing.schedule(spark, [86, 34]).collect())]
    seen, want = collections.Counter(), []
    for s in plan:
        if seen[s] % 3 == 0:  # a document's first word
            want.append("ab"[s])
        seen[s] += 1
    for whole in (False, True):
        got = mixing.mixed_documents(docs(spark, rows), whole).collect()
        assert [r.source for r in got] == want
        assert sum(r.text != f"w{r.doc_id}  x y" for r in got) == (0 if whole else 2)
    places = [p for r in mixing.mix(docs(spark, rows))[0].collect() for p in r.places or []]
    assert sorted(x.slot for p in places for x in p.parts) == list(range(120)) and all([x.first_word for x in p.parts] == list(range(len(p.parts))) for p in places)
