"""Boundaries against every choice of them, and batches read back from the packed rows."""

import collections
import random
import re
from itertools import combinations

from tidemark.llm import packing

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def padding(lengths, tops):
    return sum(min(t for t in tops if t >= x) - x for x in lengths)


def best(lengths, buckets):
    """The least padding over all choices of boundaries."""
    distinct = sorted(set(lengths))
    return min(padding(lengths, (*some, distinct[-1])) for n in range(min(buckets, len(distinct))) for some in combinations(distinct[:-1], n))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        lengths = rng.choices(rng.sample(range(60), 8) + [5000, 70_001], k=40)
        counts = collections.Counter(lengths)
        k = rng.randint(1, 5)
        got = packing.optimal_boundaries(sorted((x, c, x * c) for x, c in counts.items()), k)
        assert len(got) <= k and got[-1] == max(lengths) and padding(lengths, got) == best(lengths, k)


def some():
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 3, 8, 20, 21, 22, 40]) for _ in range(150)] + [4096, 4097, 4103, 4110, 5200, 5201, 9000]
    return [(i, " ".join(["w\u00a0x"] * n)) for i, n in enumerate(sizes)] + [(None, None), (None, "a\n\tb"), (3, "same"), (3, "same"), (900, "")]


def test_rows_fill_batches_with_the_least_padding(spark):
    rows = some()
    df = spark.createDataFrame([(i, t, 1, "b", 2, "s") for i, t in rows], "doc_id long, text string, length int, batch string, _uid int, bucket string")
    got = packing.pack(df, budget=300, buckets=4).collect()
    lengths = [len(TOKEN.findall(t or "")) for _, t in rows]
    key = lambda i, n: (-1 if i is None else i, n)
    assert sorted(key(r.doc_id, r.length) for r in got) == sorted(key(i, n) for (i, _), n in zip(rows, lengths))
    assert sum(r.padding for r in got) == best(lengths, 4) and all(r.padding == r.boundary - r.length >= 0 for r in got)
    batches = collections.defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
    short = collections.Counter()
    for (bucket, _), group in batches.items():
        assert sorted(r.slot for r in group) == list(range(len(group))) and len(group) <= group[0].capacity
        assert len(group) * group[0].boundary <= 300 or len(group) == 1
        assert len({r.boundary for r in group}) == 1
        short[bucket] += len(group) < group[0].capacity
    assert all(n <= 1 for n in short.values())


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    empty = packing.pack(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert [(r.length, r.boundary, r.padding) for r in empty] == [(0, 0, 0)] * 2
