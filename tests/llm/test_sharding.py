"""Equal texts stay together, shards are balanced, slots have no gaps, and the placement is checked by brute force."""

import collections
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import sharding


def greedy(loads, shards):
    """The placement in plain Python: largest first, to the highest dot product among shards with room."""
    room = [[1.0 / shards] * len(loads[0]) for _ in range(shards)]
    to = {}
    for i in sorted(range(len(loads)), key=lambda i: (-max(loads[i]), -sum(loads[i]), i)):
        fits = [s for s in range(shards) if all(r >= x - 1e-12 for r, x in zip(room[s], loads[i]))] or range(shards)
        to[i] = max(fits, key=lambda s: (sum(r * x for r, x in zip(room[s], loads[i])), -s))
        room[to[i]] = [r - x for r, x in zip(room[to[i]], loads[i])]
    return [to[i] for i in range(len(loads))]


@pytest.mark.parametrize("seed", range(4))
def test_place(seed):
    loads = np.random.default_rng(seed).integers(1, 64, (60, 3)).astype(float) ** 2
    loads /= 2.0 ** np.ceil(np.log2(loads.sum(axis=0)))  # exact in floats
    assert sharding.place(loads, 5).tolist() == greedy(loads.tolist(), 5)


def check(rows, texts, shards):
    """Slots without gaps, every row once; returns the shards of each text and the bytes of each shard."""
    where, size = collections.defaultdict(set), collections.Counter()
    for r in rows:
        where[r.text_crc32, r.size].add(r.shard)
        size[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    key = lambda i, t: (-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in rows) == sorted(key(i, t) for i, t in texts)
    return where, size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_stay_whole_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    where, size = check(sharding.shard(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 8)
    assert all(len(s) == 1 for s in where.values())
    assert max(abs(8 * n / sum(size.values()) - 1) for n in size.values()) < 0.04


def test_only_a_group_above_the_fair_share_is_split(spark):
    rng = random.Random(0)
    texts = [(i, f"text {rng.random()} " * rng.randint(1, 20)) for i in range(300)]
    texts += [(1000 + i, "a copy in a third of all rows") for i in range(200)] + [(2000 + i, "a copy just below the share") for i in range(60)]
    texts += [(None, None), (None, None), (5, "twice"), (5, "twice"), (6, "")]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in texts], "doc_id long, text string, shard string, slot int, digest string, _uid int")
    where, _ = check(sharding.shard(df, 8).collect(), texts, 8)
    split = [k for k, s in where.items() if len(s) > 1]
    assert split == [(zlib.crc32(b"a copy in a third of all rows"), 30)] and len(where[split[0]]) <= 4
    one = sharding.shard(df, 1).collect()
    assert {r.shard for r in one} == {0} and len(one) == len(texts)
    assert sharding.shard(df.limit(0)).count() == 0
