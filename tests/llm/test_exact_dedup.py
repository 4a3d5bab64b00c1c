"""Exact copies against grouping in plain Python, the index batch by batch, its filters, and clashing digests."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup
from tidemark.llm.exact_dedup import DigestIndex, Filter

SCHEMA = "doc_id long, text string, uid int, digest string, `a.b` int, batch int, kept string"
norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def some():
    rng = random.Random(0)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb\n", "c", "", None, f"own {i}", "x" * 5000, "\u00a0", " "])) for i in range(200)]
    return rows + [(None, "a b"), (None, None), (7, "twice"), (7, "twice"), (None, "no id"), (3000, "long " * 50_000), (2000, "long\n" * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "y", 2, 3, "z") for i, t in rows], SCHEMA)


def want(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return groups


def low(ids):
    return min((x for x in ids if x is not None), default=None)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("one")])
def test_matches_grouping(spark, digest):
    groups = want(some())
    got = exact_dedup.exact_dedup(frame(spark, some()), digest=digest).collect()
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    assert len(got) == len(some()) and sum(r.kept for r in got) == len(groups)
    for r in got:
        assert r.group_size == len(by[r.text_sha256]) and r.keep_id == low(by[r.text_sha256])


def test_keep_first(spark):
    rows = frame(spark, some())
    kept = exact_dedup.keep_first(rows)
    assert kept.columns == rows.columns and {(r.uid, r.digest, r["a.b"], r.batch, r.kept) for r in kept.collect()} == {(1, "y", 2, 3, "z")}
    assert sorted((norm(r.text), str(r.doc_id)) for r in kept.collect()) == sorted((t, str(low(v))) for t, v in want(some()).items())


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0 and exact_dedup.keep_first(frame(spark, [])).count() == 0


def test_index_finds_hits_batch_by_batch(spark):
    rng = random.Random(1)
    index, seen, uid = DigestIndex(spark, fan_in=2), collections.defaultdict(list), 0
    for batch in range(5):
        rows = [(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("0123"), rng.randint(0, 99) or None, uid + k) for k in range(15)]
        uid += 15
        hits = {r.digest for r in index.add(spark.createDataFrame(rows, "digest string, doc_id long, uid long")).collect()}
        for d, i, u in rows:
            seen[d].append((i is None, i or 0, u))
        assert hits == {d for d, _, _ in rows if len(seen[d]) > 1}
        assert all(len(level) < 2 for level in index.levels)
    assert len(index.runs()) == 2  # 5 batches in binary: levels of 4 and 1
    level = index.compact()
    assert {r.digest: (r.rows, (r["first"].none, r["first"].doc_id or 0, r["first"].uid)) for r in level.collect()} == {d: (len(v), min(v)) for d, v in seen.items()}


def test_filter_holds_all_and_little_else(spark):
    rows = spark.range(9000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    bloom = Filter(rows, 9000)
    assert bloom.blocks == 3 and bloom.maybe(rows).count() == 9000
    others = spark.range(9000, 29_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    assert bloom.maybe(others).count() < 0.05 * 20_000
