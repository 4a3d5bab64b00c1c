"""The rows of the pipeline, stage by stage, against a plain Python version of the five stages."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_exact_dedup import norm as one_space
from test_mixing import TOKEN, level
from test_near_dup import brute as near_brute
from test_packing import best
from tidemark.llm import language_id
from tidemark.llm.language_id import EVIDENCE, UNKNOWN

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row int, `a.b` string, _uid long"
WORDS = {"en": "the and of to in is that it was for on are with his they".split(), "de": "der die und das nicht ist ein zu mit sich auf auch werden".split(), "fr": "le de un et les des en une que est pour qui dans du".split()}


def some(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 60)))
        rows.append((i, text, lang, rng.choice(["a", "a", "b", "c", None])))
    for i in range(0, 60, 4):
        t = rows[i][1].split()
        t[len(t) // 2] = "\u00e9x"
        rows += [(1000 + i, " ".join(t), rows[i][2], "b"), (500 + i, rows[i][1].replace(" ", "\t\n"), None, "a")]
    return rows + [(5000, None, None, None), (5001, "", "en", "a"), (5002, "12 34 !", "en", "a"), (5003, " the  ", None, "c"), (7, rows[7][1], "en", "c"), (5004, "and " * 3000, "en", "b")]


def mass(word, pieces, k, longest):
    """Probability of a word, summed over its segmentations by prefixes."""
    sums = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            p = pieces.get(word[i:j])
            sums[j] += sums[i] * (p[k] if p else UNKNOWN if j - i == 1 else 0.0)
    return sums[-1]


def speaks(text, model, known):
    """Whether the language stage keeps the text."""
    langs, prior, pieces = model
    if text is None or not any(map(str.isalpha, text)):
        return False
    words = re.findall(r"[^\W\d_]+", text.lower())
    longest = max(map(len, pieces))
    for w in set(words) - set(known):
        known[w] = [math.log(mass("\u2581" + w, pieces, k, longest)) for k in range(len(langs))]
    total = [prior[k] + sum(known[w][k] for w in words) for k in range(len(langs))]
    top = max(total)
    return 1 / sum(math.exp((t - top) * min(1.0, EVIDENCE / len(words))) for t in total) >= corpus_pipeline.LEAST_SCORE


def stages(rows, model, hashes):
    """What every stage keeps, as (doc_id, text, source), in plain Python; the last as lengths."""
    known = {}
    kept = [r for r in rows if speaks(r[1], model, known)]
    yield kept
    first = {}
    for r in kept:
        first[one_space(r[1])] = min(first.get(one_space(r[1]), r), r, key=lambda x: x[0])
    kept = [r for r in kept if any(r is f for f in first.values())]
    yield kept
    _, classes = near_brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if classes[one_space(r[1]).strip(" ")][0] == r[0]]
    yield kept
    names = sorted({r[2] for r in kept}, key=lambda s: (s is None, s or ""))
    size = lambda t: len(TOKEN.findall(t))
    sizes = [sum(size(r[1]) for r in kept if r[2] == n) for n in names]
    mixed = []
    for name, target in zip(names, level(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])):
        line = sorted((r for r in kept if r[2] == name), key=lambda r: ((hashes[r[0]] >> 32) & 0xFFFFFFFF, hashes[r[0]]))
        left = round(target)
        for r in line * 3:
            if left > 0:
                mixed.append(r)
                left -= size(r[1])
    yield mixed
    yield [(r[0], size(r[1])) for r in mixed]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(i, t, lang, s, 3, 0.5, "clash", 1, "dot", 2) for i, t, lang, s in some()], SCHEMA)
    df.repartition(3).write.parquet(str(path / "documents.parquet"))
    return path


def test_stages_match_plain_python(spark, folder):
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = language_id.fit(docs.select("text", "lang"))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, stages(rows, model, hashes), strict=True)):
        got = stage(spark, docs, str(folder))
        if name == "packing":
            break
        assert got.columns == docs.columns
        got.write.parquet(str(folder / f"stage{k}"))
        docs = spark.read.parquet(str(folder / f"stage{k}"))
        found = docs.collect()
        assert {(r.score, r.lang_pred, r.row, r["a.b"], r._uid) for r in found} == {(0.5, "clash", 1, "dot", 2)}
        assert sorted(key((r.doc_id, r.text, r.source)) for r in found) == sorted(map(key, want)), name
    packed = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((r.doc_id, r.length) for r in got.collect()) == sorted(want)
    assert sum(r.padding for r in packed) == sum(r.boundary - r.length for r in packed)
    tops = sorted({r.boundary for r in packed})
    lengths = collections.Counter(n for _, n in want)
    assert len(tops) <= 16 and all(min(t for t in tops if t >= n) >= n for n in lengths)
    if len(lengths) <= 18:
        assert sum(r.padding for r in packed) == best([n for _, n in want], 16)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(str(folder / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
