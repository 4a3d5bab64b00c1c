"""Links and classes against all pairs, the forest against tries built one by one, and its recall on the tables."""

import collections
import random
import re

import numpy as np
import pytest

from tidemark.llm import near_dup
from tidemark.llm.near_dup import DEPTH, LEAST, SPARSE, THRESHOLD, TREES, least_similarity, needed_depth, permutations, shingles, signature

SCHEMA = "doc_id long, text string, uid int, digest string, `a.b` int, links int, node long"
norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "y", 2, 3, 4) for i, t in rows], SCHEMA)


def some(seed=0, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [rng.choices(words, k=rng.randint(1, 90)) for _ in range(n)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(0, 60):
        t = list(texts[i % 40])
        for _ in range(rng.randint(1, 2)):
            t[rng.randrange(len(t))] = f"new{rng.random()}"
        rows += [(1000 + i, " ".join(t)), (2000 + i, "\n\t".join(t[:-1] or t))]
    base = [f"c{i}" for i in range(200)]  # a large group of near copies
    for i in range(90):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((4000 + i, " ".join(t)))
    return rows + [(5000, None), (5001, ""), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (5002, "\u20ac \U0001f600 " * 9000), (5003, "one two three"), (5004, "one two three four"), (5005, " \t "), (5006, rows[3][1] + "\n")]


def brute(rows):
    """(links of each text, class id of each text)."""
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[norm(t)].append(i)
    grams = {t: {tuple(t.split(" ")[k : k + 5]) for k in range(max(1, len(t.split(" ")) - 4))} if t else set() for t in ids}
    texts, links, root = list(ids), collections.Counter(), {t: t for t in ids}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            if grams[a] and len(grams[a] & grams[b]) >= THRESHOLD * len(grams[a] | grams[b]) - 1e-9 and grams[b]:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for t in texts:
        members[find(t)] += ids[t]
    low = lambda v: min((x for x in v if x is not None), default=None)
    return {t: links[t] for t in texts}, {t: (low(members[find(t)]), len(members[find(t)])) for t in texts}


@pytest.mark.parametrize("block", [256, 16])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)  # 16: several blocks of one component
    rows = some()
    links, classes = brute(rows)
    got = near_dup.jaccard_classes(frame(spark, rows)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(key(r) for r in map(tuple, got)) == sorted(key((i, classes[norm(t)][0], classes[norm(t)][1], links[norm(t)])) for i, t in rows)
    assert max(links.values()) >= 89


def test_keep_one(spark):
    rows = some(1, 40)
    _, classes = brute(rows)
    df = frame(spark, rows)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and {(r.uid, r["a.b"], r.node) for r in kept.collect()} == {(1, 2, 4)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c in {classes[norm(t)] for _, t in rows} for c in [c[0]])


def test_empty_table(spark):
    assert near_dup.jaccard_classes(frame(spark, [])).count() == 0 and near_dup.keep_one(frame(spark, [])).count() == 0


def test_depths_reach_the_recall():
    for size in range(1, 400):
        s = least_similarity(size)
        pairs = [shared / u for u in range(size, 2 * size + 2) for shared in range(size + 1) if THRESHOLD - 1e-9 <= shared / u]
        assert size > 200 and s == THRESHOLD or s == pytest.approx(min(pairs))
        assert 1 - (1 - s ** needed_depth(size)) ** TREES >= near_dup.RECALL
    assert needed_depth(3) == DEPTH and needed_depth(7) == DEPTH and needed_depth(6) == 7 and needed_depth(1000) == 6


def test_forest_is_that_of_tries_built_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SPARSE", 4)
    texts = {k: t for k, t in enumerate(dict.fromkeys(norm(t) for _, t in some()))}
    functions = permutations(TREES * DEPTH)
    signed = {k: (max(LEAST, needed_depth(len(h))), (signature(h, *functions) & 0xFFFF).reshape(TREES, DEPTH)) for k, t in texts.items() if len(h := shingles(t))}
    want = {}
    for tree in range(TREES):
        nodes = collections.defaultdict(list)
        for k, (_, s) in signed.items():
            for d in range(LEAST, DEPTH + 1):
                nodes[tuple(s[tree, :d])].append(k)
        opened = {p for p, ks in nodes.items() if len(ks) > 1 and any(signed[k][0] == len(p) or signed[k][0] > len(p) and len(ks) <= 4 for k in ks)}
        for k, (_, s) in signed.items():
            mine = [d for d in range(LEAST, DEPTH + 1) if tuple(s[tree, :d]) in opened]
            if mine:
                want[k, tree] = (mine[0], min(nodes[tuple(s[tree, : mine[0]])]))
    got = near_dup.forest(spark.createDataFrame(list(texts.items()), "uid long, text string")).collect()
    assert {(r.uid, r.tree): (r.depth, r.first) for r in got} == want and len({d for d, _ in want.values()}) > 1
    by = collections.defaultdict(set)
    for r in got:
        by[r.node].add((r.tree, r.depth, r.first))
    assert all(len(v) == 1 for v in by.values())


def test_recall_near_the_threshold(spark):
    """Texts of a table, and pairs planted just above the threshold, against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    rng = random.Random(3)
    pairs = [[f"a{rng.random()}" for _ in range(rng.randint(60, 200))] for _ in range(600)]
    texts = [norm(r.text) for r in docs]
    for t in pairs:
        cut = len(t) - int(len(t) * rng.uniform(0.13, 0.19))  # the second has some of the first's words, at its start
        texts += [" ".join(t), " ".join(t[:cut])]
    texts = list(dict.fromkeys(texts))
    grams = [shingles(t) for t in texts]
    values, owner = np.concatenate(grams), np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    order = np.argsort(values, kind="stable")
    shared = np.zeros((len(texts), len(texts)), np.int64)
    for docs_of in np.split(owner[order], np.flatnonzero(np.diff(values[order])) + 1):
        if len(docs_of) > 1:
            shared[np.ix_(docs_of, docs_of)] += 1
    size = np.array([len(g) for g in grams])
    similar = (shared >= THRESHOLD * (size[:, None] + size - shared) - 1e-9) & (shared > 0)
    np.fill_diagonal(similar, False)
    got = {r.uid: r.links for r in near_dup.link(spark.createDataFrame(list(enumerate(texts)), "uid long, text string")).collect()}
    want = {k: int(n) for k, n in enumerate(similar.sum(axis=1)) if n}
    found, all_links = sum(min(got.get(k, 0), n) for k, n in want.items()), sum(want.values())
    assert all(got[k] <= want[k] for k in got) and all_links > 900 and found >= 0.995 * all_links


def test_components_of_long_chains(spark):
    chain = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(2001, 2000)]
    got = near_dup.components(spark.createDataFrame(chain, "a long, b long"))
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)} | {2001: 2000}
    assert {r.node: r.root for r in got.collect()} == want
