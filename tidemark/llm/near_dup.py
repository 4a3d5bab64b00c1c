"""N-gram Jaccard join by a MinHash LSH forest with exact verification, and its near-duplicate classes.

Every document has a signature of DEPTH values in each of TREES trees. A tree is the sorted list of its signatures,
which is a prefix trie: the documents below a node are those that share its prefix. Each document starts from its
whole signatures and shortens the matched prefixes until its recall reaches the target, and on as long as what it
finds stays little; how far depends on the document (see ``needed_depth`` and ``forest``).
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WS, materialize, maybe_broadcast

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, values of a signature in each, the shortest prefix that is matched, and the probability with which a pair
#: at the threshold has to be found.
TREES, DEPTH, LEAST, RECALL = 24, 8, 5, 0.999
#: Documents under a node up to which prefixes are shortened beyond what the target recall needs.
SPARSE = 16
#: Documents of a block in verification; a unit of work is one block, or two of the same component.
BLOCK = 256
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=4096)
def least_similarity(size: int, threshold: float = THRESHOLD) -> float:
    """The smallest similarity of the threshold or more that a set of ``size`` elements can have with another set."""
    if size > 200:  # hardly above the threshold any more
        return threshold
    unions = range(size, int(size / threshold + 1e-9) + 1)
    return min(shared / u for u in unions if (shared := math.ceil(threshold * u - 1e-9)) <= size)


@lru_cache(maxsize=4096)
def needed_depth(size: int, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Shorten the prefixes of a document of ``size`` shingles from ``depth`` until 1 - (1 - s^d)^trees is the recall.

    s is the least similarity that counts and that such a document can have; so short documents, whose similarities
    are far apart, can keep longer prefixes.
    """
    s = least_similarity(size, threshold)
    while depth > 1 and 1 - (1 - s**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a text of 1 to n - 1 words is one shingle."""
    words = _TOKEN.findall(text.encode("utf-8", "surrogatepass"))
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    mixed = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        mixed = (mixed ^ codes[i : len(codes) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    if len(words) < n:
        mixed ^= np.uint64(len(words))
    return np.unique(mixed)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash functions."""
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the hash functions (multipliers ``a``, offsets ``b``) over the shingles."""
    count = len(a)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        x = low[at : at + 2048, None] * a + b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _signed(batches):
    """(uid, deep, signature): signatures are 2-byte numbers whose bytes sort like them, tree after tree.

    Of each minimum the low 16 bits are kept: two documents that share no shingle agree on LEAST of them by chance with
    probability 2^-80, and what meets is verified.
    """
    functions = permutations(TREES * DEPTH)
    for b in batches:
        rows = []
        for uid, text in zip(b["uid"], b["text"]):
            h = shingles(text)
            if len(h):
                rows.append((uid, max(LEAST, needed_depth(len(h))), signature(h, *functions).astype(">u2").tobytes()))
        yield pd.DataFrame(rows, columns=["uid", "deep", "signature"])


def _shingled(batches):
    for b in batches:
        yield b.assign(shingles=[shingles(t).tobytes() for t in b["text"]])[["uid", "shingles", "root", "blocks", "block"]]


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) with the smallest node of each component of the edges (a, b), b < a.

    Alternates linking neighbours to the smallest one and pointer jumping, in tables in the shared folder;
    nothing but the number of changes reaches the driver.
    """
    links = materialize(edges.where("b < a").distinct(), "links")
    for _ in range(max_rounds):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least ones are written, so that both sides of the join are plain and Spark can split a hot node.
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
        # Large star, then small star: all neighbours are linked to the smallest.
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("b < a").distinct()
        large = materialize(large, "large")
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "down")
        small = large.join(down, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("b < a").distinct()
        new = materialize(small, "links")
        state = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        done = state(new) == state(links)
        links = new
        if done:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _verify(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of pairs that meet in a node and have exact Jaccard similarity of THRESHOLD or more."""
    p, q = np.stack(left["nodes"].to_numpy()), np.stack(right["nodes"].to_numpy())
    near = np.zeros((len(p), len(q)), bool)
    for t in range(p.shape[1]):
        near |= (p[:, t, None] == q[None, :, t]) & (p[:, t, None] != 0)
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return i, j
    a, b = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right))
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fit = np.minimum(na[i], nb[j]) >= THRESHOLD * np.maximum(na[i], nb[j])
    i, j = i[fit], j[fit]
    both = np.zeros(len(i), np.int64)
    # Intersections: each left document marks its shingles among the right side's, numbered once.
    if len(i):
        used = np.unique(j)
        values, codes = np.unique(np.concatenate([b[k] for k in used]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(nb[used])])
        place = {k: n for n, k in enumerate(used.tolist())}
        owner = np.repeat(np.arange(len(used)), nb[used])
        at = 0
        while at < len(i):
            end = at + int(np.searchsorted(i[at:], i[at], side="right"))
            found = np.searchsorted(values, a[i[at]])
            found[found == len(values)] = 0
            mark = np.zeros(len(values), bool)
            hit = found[values[found] == a[i[at]]]
            mark[hit] = True
            if (end - at) * 8 > len(used):
                shared = np.bincount(owner, weights=mark[codes], minlength=len(used)).astype(np.int64)
                both[at:end] = shared[[place[k] for k in j[at:end].tolist()]]
            else:
                for n in range(at, end):
                    k = place[int(j[n])]
                    both[n] = np.count_nonzero(mark[codes[starts[k] : starts[k + 1]]])
            at = end
    ok = both >= THRESHOLD * (na[i] + nb[j] - both) - 1e-9
    return i[ok], j[ok]


def _forest_of(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (larger, smaller root) that connect what the pairs connect: at most one a document."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]


def forest(texts: DataFrame) -> DataFrame:
    """(uid, tree, depth, node, first): where each text meets others, and the smallest uid there.

    texts: (uid, text), texts distinct. A node is open if a text under it has shortened its prefix that far: to its
    needed depth in any case, and up to LEAST where at most SPARSE texts share the prefix. A text takes its
    shallowest open node of each tree, so two texts meet if one of them has shortened enough to find the other.
    """
    at = F.col("tree") * (2 * DEPTH) + 1
    part = lambda n: F.substring("signature", at, F.lit(2 * n))
    signed = materialize(texts.mapInPandas(_signed, "uid long, deep int, signature binary"), "signed")
    # Texts alone under the shortest prefix of a tree have no neighbour in it: they are left out first.
    tops = signed.select("uid", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature").select("uid", "tree", F.xxhash64("tree", part(LEAST)).alias("top"))
    shared = materialize(tops.groupBy("top").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("top").alias("t")), "tops")
    # The joins below are merges at every size: a side that is small in a small table is not in a large one.
    met = materialize(tops.join(shared.hint("merge"), F.col("top") == F.col("t"), "left_semi").groupBy("uid").agg(F.collect_list("tree").alias("trees")), "met")
    keys = signed.join(met.withColumnRenamed("uid", "u").hint("merge"), F.col("uid") == F.col("u")).select("uid", "deep", F.explode("trees").alias("tree"), "signature").select("uid", "deep", "tree", part(DEPTH).alias("key"))
    # The sorted lists. The uid breaks ties, so that no range of them is hot.
    tries = materialize(keys.repartitionByRange("tree", "key", "uid").sortWithinPartitions("tree", "key", "uid"), "tries")
    depths = F.explode(F.sequence(F.lit(LEAST), F.lit(DEPTH)))
    paths = tries.select("uid", "deep", "tree", depths.alias("depth"), "key").select("uid", "deep", "tree", "depth", F.xxhash64("tree", "depth", F.substring("key", F.lit(1), 2 * F.col("depth"))).alias("node"))
    counted = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first"), F.max(F.col("deep") == F.col("depth")).alias("needed"), F.max(F.col("deep") > F.col("depth")).alias("beyond"))
    opened = materialize(counted.where((F.col("n") > 1) & (F.col("needed") | (F.col("beyond") & (F.col("n") <= SPARSE)))).select(F.col("node").alias("open"), "first"), "open")
    found = paths.join(opened.hint("merge"), F.col("node") == F.col("open"))
    return found.groupBy("uid", "tree").agg(F.min(F.struct("depth", "node", "first")).alias("s")).select("uid", "tree", "s.depth", "s.node", "s.first")


def link(texts: DataFrame) -> DataFrame:
    """Links between different texts: (uid, links, root) for every text that has one.

    texts: (uid, text), texts distinct. Texts that meet in a node of the forest fall in one candidate component,
    whose members' shingles are then compared block by block. A unit returns the number of links of each document
    and a spanning forest, never the pairs, so large groups of near copies give rows in proportion to their size;
    all their pairs are compared nevertheless.
    """
    met = materialize(forest(texts), "forest")
    parts = components(met.where("uid > first").select(F.col("uid").alias("a"), F.col("first").alias("b")))
    by_tree = met.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("m"))
    nodes = by_tree.select(F.col("uid").alias("s"), F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.col("m")[t], F.lit(0))).alias("nodes"))
    members = materialize(parts.select("node", "root").union(parts.select("root", "root").distinct()), "members")
    sizes = materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("root", "r"), "component_sizes")
    n = members.count()
    placed = members.join(sizes, F.col("root") == F.col("r")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = maybe_broadcast(materialize(placed.select("node", "root", "blocks", "block"), "placed"), n, 40)
    # Only the members' texts are read again for their shingles; all others have no candidate.
    held = texts.join(placed, F.col("uid") == F.col("node")).select("uid", "text", "root", "blocks", "block").mapInPandas(_shingled, "uid long, shingles binary, root long, blocks int, block int")
    held = held.join(nodes.hint("merge"), F.col("uid") == F.col("s"))
    # A block meets itself and each later one: (x, y) with x <= y.
    units = held.withColumn("unit", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["block"] == key[1]]
        same = key[1] == key[2]
        right = left if same else rows[rows["block"] == key[2]]
        out = []
        if len(left) and len(right):
            i, j = _verify(left, right, same)
            u, v = left["uid"].to_numpy()[i], right["uid"].to_numpy()[j]
            ids, counts = np.unique(np.concatenate([u, v]), return_counts=True)
            forest = dict(_forest_of(list(zip(u.tolist(), v.tolist()))))
            out = [(int(a), int(c), forest.get(int(a))) for a, c in zip(ids, counts)]
        frame = pd.DataFrame(out, columns=["uid", "links", "to"])
        return frame.astype({"uid": "int64", "links": "int64", "to": "Int64"})

    found = units.select("root", F.col("unit.x").alias("x"), F.col("unit.y").alias("y"), "block", "uid", "shingles", "nodes").groupBy("root", "x", "y").applyInPandas(compare, "uid long, links long, to long")
    found = materialize(found, "found")
    linked = found.groupBy("uid").agg(F.sum("links").alias("links"))
    joined = components(found.where("to IS NOT NULL").select(F.col("uid").alias("a"), F.col("to").alias("b")))
    return linked.join(joined, F.col("uid") == F.col("node"), "left").select("uid", "links", F.coalesce("root", "uid").alias("root"))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The documents with a row id, (row, class_row, n_links) for each, and the number of different texts.

    Copies (equal up to white space) are one text; its row is the one with the smallest id. class_row is the
    smallest such row connected by links of similarity THRESHOLD or more; n_links counts the other texts
    linked to the document's text. Texts without a word, and null ones, are each a class of their own per
    distinct (empty) text, without links.
    """
    norm = F.trim(F.regexp_replace(F.coalesce("row.text", F.lit("")), WS, " "))
    # The caller's columns lie in a struct, so their names clash with nothing.
    staged = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_row")), "docs")
    digest = F.sha2(norm, 256)
    keys = materialize(staged.select("_row", F.col("row.doc_id").alias("doc_id"), digest.alias("digest")), "keys")
    first = keys.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("f"), F.count(F.lit(1)).alias("n")).select("digest", F.col("f._row").alias("first"))
    first = materialize(first, "first")
    n = first.count()
    # The texts that stand for their copies, chosen by row id; only they are hashed.
    chosen = staged.join(maybe_broadcast(first.select("first"), n, 16), F.col("_row") == F.col("first"), "left_semi")
    linked = link(chosen.select(F.col("_row").alias("uid"), F.coalesce("row.text", F.lit("")).alias("text")))
    classes = first.join(linked.hint("merge"), F.col("first") == F.col("uid"), "left").select("digest", F.coalesce("root", "first").alias("class_row"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    classes = materialize(classes, "classes")  # so that the join below is of two plain sides, and a hot digest can be split
    rows = keys.join(classes, "digest").select("_row", "doc_id", "class_row", "n_links")
    return staged, rows, n


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, n_links for every document.

    Nulls, empty texts and copies as in ``near_classes``; repeated rows are documents of their own; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    _, rows, _ = near_classes(docs.select("doc_id", "text"))
    rows = materialize(rows, "rows")
    ids = rows.groupBy("class_row").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).select(F.col("class_row").alias("c"), "class_id", "class_size")
    ids = materialize(ids, "ids")
    return rows.join(ids, F.col("class_row") == F.col("c")).select("doc_id", "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with the columns of ``docs``.

    Null ids go last, ties by the row. Other columns pass unchanged, whatever their names; an empty table gives no rows.
    """
    staged, rows, n = near_classes(docs)
    best = rows.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("f")).select(F.col("f._row").alias("_kept"))
    return staged.join(maybe_broadcast(best, n, 16), F.col("_row") == F.col("_kept"), "left_semi").select("row.*")
