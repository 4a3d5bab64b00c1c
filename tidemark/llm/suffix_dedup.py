"""Bytes covered by repeated strings, by a distributed merge sort of front-coded suffix runs with loser trees.

A window (``length`` bytes) is repeated if the same bytes start anywhere else. Each window has an anchor: its
lowest-hashed CHUNK bytes, which a repetition of the window has at the same offset. The windows of one anchor
lie in one stretch of the text, and stretches are compared first: if no other stretch has the chunk, none of
its windows is repeated; if an equal stretch exists (by a 128-bit BLAKE2b digest of its bytes), all are. What is left, stretches that share a chunk and
differ elsewhere, goes through the suffix sort, one stretch for each different content, as the suffix that
starts at the anchor: sorted runs, front-coded, are exchanged by key range, and a loser tree that knows the
common prefixes merges them. Windows of neighbours are then told apart by those prefixes and their left sides.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import drop_tables, materialize, maybe_broadcast, recorded

LENGTH = 200
CHUNK_SHARE = 0.32
#: Bytes of text hashed at once, windows of a sorted run, and key ranges of the exchange.
BATCH, RUN, RANGES = 1 << 20, 1 << 17, 64
#: Stretches of one chunk beyond which each window is an entry of its own, so that no key range is hot.
WIDE = 2048
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INDEX = _U((1 << 22) - 1)


class Hasher:
    """Hashes of all chunks of a buffer: sums of random byte values times powers of an odd base, mod 2^64."""

    def __init__(self, most: int) -> None:
        rng = np.random.default_rng(11)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        inverse = pow(_BASE, -1, 1 << 64)
        self.powers, self.inverses = (np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(most, b, _U))]) for b in (_BASE, inverse))

    def prefix(self, buffer: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buffer) + 1, _U)
        np.cumsum(self.values[buffer] * self.powers[: len(buffer)], out=out[1:])
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i, from running minima inside blocks of ``width``."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(_U).max, _U)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretches(texts: list[bytes], hasher: Hasher, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, bytes before the anchor, chunk hash, content digest) of every stretch.

    The digest, two columns of 64 bits, is a cryptographic one (BLAKE2b) of the stretch's bytes and its shape.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    chunk = max(1, int(length * CHUNK_SHARE))
    width = length - chunk + 1
    whole = b"".join(texts)
    buffer = np.frombuffer(whole, np.uint8)
    empty = np.empty(0, np.int64)
    if len(buffer) < length:
        return (*(empty,) * 5, np.empty((0, 2), np.int64))
    prefix = hasher.prefix(buffer)
    n = len(buffer) - chunk + 1
    value = (prefix[chunk:] - prefix[:n]) * hasher.inverses[:n]
    value ^= value >> _U(31)
    value *= _U(0xD6E8FEB86659FD93)
    order = (value & ~_INDEX) | np.arange(n, dtype=_U)
    anchor = (sliding_min(order, width) & _INDEX).astype(np.int64)
    whose = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    fits = np.arange(len(anchor)) + length <= ends[whose]
    # A stretch starts where the anchor changes or windows begin to fit in their text.
    start = fits.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1] | (whose[1:] != whose[:-1])
    first = np.flatnonzero(start)
    if not len(first):
        return (*(empty,) * 5, np.empty((0, 2), np.int64))
    stop = np.flatnonzero(fits & ~np.concatenate([fits[1:] & ~start[1:], [False]]))
    at = anchor[first]
    blake = hashlib.blake2b
    # The place of the anchor goes in too: equal bytes with another anchor are another shape.
    digests = b"".join([blake(whole[a:z], digest_size=16, salt=b"%d" % o).digest() for a, z, o in zip(first.tolist(), (stop + length).tolist(), (at - first).tolist())])
    text = whose[first]
    return text, first - (ends - sizes)[text], stop - first + 1, at - first, value[at].view(np.int64), np.frombuffer(digests, np.int64).reshape(-1, 2)


def front_code(keys: list[bytes]) -> bytes:
    """Sorted keys as lengths, common prefix lengths and what follows the prefixes, compressed."""
    sizes = np.array([len(k) for k in keys])
    width = int(sizes.max(initial=1))
    inside = np.arange(width)[None, :] < sizes[:, None]
    table = np.zeros(inside.shape, np.uint8)
    table[inside] = np.frombuffer(b"".join(keys), np.uint8)
    common = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differs = table[1:] != table[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        common[1:] = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
    rest = table[inside & (np.arange(width)[None, :] >= common[:, None])]
    return zlib.compress(sizes.astype(np.uint16).tobytes() + common.astype(np.uint16).tobytes() + rest.tobytes(), 1)


def front_decode(blob: bytes, count: int) -> tuple[np.ndarray, list[bytes]]:
    """(common prefix length with the key before, keys)."""
    raw = zlib.decompress(blob)
    sizes, common = (np.frombuffer(raw, np.uint16, count, offset=o).astype(np.int64) for o in (0, 2 * count))
    width = int(sizes.max(initial=1))
    column = np.arange(width)[None, :]
    own = (column >= common[:, None]) & (column < sizes[:, None])
    table = np.zeros((count, width), np.uint8)
    table[own] = np.frombuffer(raw, np.uint8, offset=4 * count)
    # A byte inside the common prefix is that of the last key before which gave it.
    given = np.where(own, np.arange(count)[:, None], 0)
    np.maximum.accumulate(given, axis=0, out=given)
    flat = np.take_along_axis(table, given, axis=0).tobytes()
    return common, [flat[i * width : i * width + n] for i, n in enumerate(sizes.tolist())]


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n]) ^ int.from_bytes(b[start:n])
    return n - (x.bit_length() + 7 >> 3) if x else n


def merge_runs(runs: list[tuple[np.ndarray, list[bytes]]]):
    """(run, index, common prefix with the key before) of all keys in order.

    A loser tree in which each head knows its common prefix with the key given out last: the head with the
    longer prefix is the smaller, and bytes are compared only past equal prefixes.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    commons = [c.tolist() for c, _ in runs]
    rows = [r for _, r in runs]
    at, lens = [0] * k, [len(r) for r in rows]
    head: list[bytes | None] = [r[0] if r else None for r in rows] + [None] * (size - k)
    known = [-1 if h is None else 0 for h in head]  # -1: the run has ended

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its common prefix with the winner."""
        p, q = known[x], known[y]
        if p > q:
            return x, y
        if q > p:
            return y, x
        if p < 0:
            return x, y
        a, b = head[x], head[y]
        c = _common(a, b, p)
        if c == len(a) or (c < len(b) and a[c] < b[c]):
            known[y] = c
            return x, y
        known[x] = c
        return y, x

    tree, level, base = [0] * size, list(range(size)), size
    while len(level) > 1:
        base //= 2
        above = []
        for i in range(0, len(level), 2):
            w, tree[base + i // 2] = play(level[i], level[i + 1])
            above.append(w)
        level = above
    winner = level[0]
    while known[winner] >= 0:
        yield winner, at[winner], known[winner]
        at[winner] = i = at[winner] + 1
        if i < lens[winner]:
            known[winner], head[winner] = commons[winner][i], rows[winner][i]
        else:
            known[winner], head[winner] = -1, None
        node = (winner + size) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


class Piece:
    """The entries of one run in one key range: what follows the anchor is the sorted key, what leads to it ``left``."""

    def __init__(self, count: int, keys: bytes, lefts: bytes, shape: bytes) -> None:
        self.common, self.keys = front_decode(keys, count)
        left, self.windows = np.frombuffer(shape, np.uint16).reshape(2, count).astype(np.int64)
        ends, raw = np.cumsum(left), zlib.decompress(lefts)
        self.left = [raw[e - n : e] for e, n in zip(ends.tolist(), left.tolist())]
        self.first = np.concatenate([[0], np.cumsum(self.windows)])
        self.found = np.zeros(int(self.first[-1]), bool)


def settle(group: list[tuple[Piece, int]], common: list[int], length: int) -> None:
    """Mark the repeated windows of entries that follow each other with long common prefixes.

    A window that reaches o bytes to the left of the anchor and length - o to the right is repeated if another
    entry agrees on both. Entries that agree on the right side are neighbours, by the known common prefixes;
    among them the left sides are looked up.
    """
    by_offset: dict[int, list[int]] = {}
    for n, (piece, i) in enumerate(group):
        size = len(piece.left[i])
        for o in range(size - int(piece.windows[i]) + 1, size + 1):
            by_offset.setdefault(o, []).append(n)
    for o, members in by_offset.items():
        if len(members) < 2:
            continue
        seen: dict[bytes, int] = {}
        before = members[0]
        for n in members:
            if n != before and min(common[before + 1 : n + 1]) < length - o:
                seen = {}
            before = n
            piece, i = group[n]
            size = len(piece.left[i])
            other = seen.setdefault(piece.left[i][size - o :], n)
            if other != n:
                for m in (n, other):
                    p, j = group[m]
                    p.found[int(p.first[j]) + len(p.left[j]) - o] = True


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the half-open intervals cover; touching intervals are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, starts, ends) of the maximal runs of repeated bytes of each text that has any.

    docs: (uid, text), uid unique, text not null, in a table that gives the same rows when read again.
    """
    spark = docs.sparkSession

    def scan(batches):
        hasher = Hasher(2 * BATCH)
        for b in batches:
            uids, texts = b["uid"].to_numpy(), [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= BATCH:
                    size += len(texts[end])
                    end += 1
                some, names = texts[at:end], uids[at:end]
                if size > BATCH:  # one long text, in overlapping parts of at most BATCH bytes
                    t = some[0]
                    for s in range(0, len(t), BATCH - length + 1):
                        _, f, w, o, h, c = stretches([t[s : s + BATCH]], hasher, length)
                        yield pd.DataFrame({"uid": np.full(len(f), names[0]), "first": f + s, "windows": w, "left": o, "chunk": h, "content": c[:, 0], "more": c[:, 1]})
                else:
                    k, f, w, o, h, c = stretches(some, hasher, length)
                    yield pd.DataFrame({"uid": names[k], "first": f, "windows": w, "left": o, "chunk": h, "content": c[:, 0], "more": c[:, 1]})
                at = end

    kinds = "uid long, first long, windows long, left long, chunk long, content long, more long"
    early: list[str] = []
    with recorded(early):
        seen = materialize(docs.mapInPandas(scan, kinds).select("uid", F.col("first").cast("int"), F.col("windows").cast("short"), F.col("left").cast("short"), "chunk", "content", "more"), "stretches")
        # Stretches whose chunk occurs once go first; what follows works on the few that are left. Sums are written before
        # they are joined: then both sides of a join are plain, and Spark can split what one hot chunk has.
        often = materialize(seen.groupBy("chunk").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select(F.col("chunk").alias("c")), "often")
    seen = materialize(seen.join(often, F.col("chunk") == F.col("c"), "left_semi"), "shared")
    drop_tables(spark, early, [])
    contents = materialize(seen.groupBy("chunk", "content", "more").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first")).alias("own")), "contents")
    chunks = materialize(contents.groupBy("chunk").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(F.col("chunk").alias("c"), "kinds"), "chunks")
    shared = contents.join(chunks, F.col("chunk") == F.col("c"), "left").where("n > 1 OR kinds > 1").select(F.col("chunk").alias("c"), F.col("content").alias("d"), F.col("more").alias("e"), (F.col("n") > 1).alias("whole"), F.col("kinds").isNotNull().alias("open"), (F.coalesce("kinds", F.lit(1)) > WIDE).alias("wide"), F.col("own.uid").alias("u"), F.col("own.first").alias("f"))
    marked = seen.join(shared, (F.col("chunk") == F.col("c")) & (F.col("content") == F.col("d")) & (F.col("more") == F.col("e"))).select("uid", "first", "windows", "left", "whole", "wide", (F.col("open") & (F.col("uid") == F.col("u")) & (F.col("first") == F.col("f"))).alias("open")).where("whole OR open")
    marked = materialize(marked.groupBy("uid").agg(F.collect_list(F.struct("first", "windows", "left", "whole", "wide", "open")).alias("parts")), "marked")
    n = marked.count()
    # Suffix runs of the stretches whose windows have to be compared.
    open_parts = marked.select(F.col("uid").alias("u"), F.filter("parts", lambda p: p["open"]).alias("parts")).where(F.size("parts") > 0)
    held = docs.join(maybe_broadcast(open_parts.select("u"), n, 16), F.col("uid") == F.col("u"), "left_semi").join(open_parts, F.col("uid") == F.col("u"))
    cuts = _splitters(docs, length)
    columns = "run string, part int, count int, keys binary, lefts binary, shape binary, uids binary, starts binary, which binary, twice binary"
    runs = materialize(held.select("uid", "text", "parts").mapInPandas(lambda batches: _sorted_runs(batches, cuts, length), columns), "runs", compression="none")

    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("run")
        parts = [Piece(*x) for x in zip(pieces["count"], pieces["keys"], pieces["lefts"], pieces["shape"])]
        chunk = max(1, int(length * CHUNK_SHARE))
        group: list[tuple[Piece, int]] = []
        common: list[int] = []
        for run, i, c in merge_runs([(p.common, p.keys) for p in parts]):
            if c < chunk:
                if len(group) > 1:
                    settle(group, common, length)
                group, common = [], []
            group.append((parts[run], i))
            common.append(c)
        if len(group) > 1:
            settle(group, common, length)
        return pd.DataFrame({"run": pieces["run"], "part": pieces["part"], "found": [np.packbits(p.found).tobytes() for p in parts]})

    merged = runs.select("run", "part", "count", "keys", "lefts", "shape").groupBy("part").applyInPandas(merge, "run string, part int, found binary")
    merged = materialize(merged, "merged").select(F.col("run").alias("r"), F.col("part").alias("p"), "found")

    def report(batches):
        for b in batches:
            for count, shape, uids, starts, which, twice, found in zip(b["count"], b["shape"], b["uids"], b["starts"], b["which"], b["twice"], b["found"]):
                windows = np.frombuffer(shape, np.uint16)[count:].astype(np.int64)
                first = np.concatenate([[0], np.cumsum(windows)])
                hit = np.unpackbits(np.frombuffer(found, np.uint8), count=int(first[-1])).astype(bool)
                hit[first[:-1][np.unpackbits(np.frombuffer(twice, np.uint8), count=count).astype(bool)]] = True
                # Each copy of an entry, and each of its windows.
                entry = np.frombuffer(which, np.int32)
                n = windows[entry]
                copy = np.repeat(np.arange(len(entry)), n)
                within = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                ok = hit[first[entry[copy]] + within]
                u, s = np.frombuffer(uids, np.int64)[copy][ok], (np.frombuffer(starts, np.int32)[copy] + within)[ok]
                order = np.lexsort((s, u))
                u, s = u[order], s[order]
                rows = []
                for k, v in zip(*np.unique(u, return_index=True)[::-1]):
                    mine = s[k : np.searchsorted(u, v, side="right")]
                    a, z = union(mine, mine + length)
                    rows.append((v, a.tolist(), z.tolist()))
                yield pd.DataFrame(rows, columns=["uid", "starts", "ends"])

    spans = "uid long, starts array<long>, ends array<long>"
    by_window = runs.drop("keys", "lefts").join(merged, (F.col("run") == F.col("r")) & (F.col("part") == F.col("p"))).mapInPandas(report, spans)
    whole = marked.select("uid", F.filter("parts", lambda p: p["whole"]).alias("parts")).where(F.size("parts") > 0)
    by_stretch = whole.select("uid", F.transform("parts", lambda p: p["first"].cast("long")).alias("starts"), F.transform("parts", lambda p: (p["first"] + p["windows"] + (length - 1)).cast("long")).alias("ends"))
    gathered = by_window.unionByName(by_stretch).groupBy("uid").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))

    def join_spans(batches):
        for b in batches:
            both = [union(np.asarray(s, np.int64), np.asarray(e, np.int64)) for s, e in zip(b["starts"], b["ends"])]
            yield pd.DataFrame({"uid": b["uid"], "starts": [x[0].tolist() for x in both], "ends": [x[1].tolist() for x in both]})

    return gathered.mapInPandas(join_spans, spans)


def _splitters(docs: DataFrame, length: int) -> list[bytes]:
    """Key ranges of the exchange, from the starts of words of a bounded sample: they balance, and decide nothing."""
    some = docs.where(F.length("text") >= length).orderBy(F.xxhash64("uid")).select(F.substring("text", 1, 4000).alias("t")).limit(64).collect()
    keys = sorted(t[i : i + 24] for r in some for t in [r["t"].encode("utf-8", "surrogatepass")] for i in range(0, max(0, len(t) - 24), 17))
    return sorted({keys[len(keys) * i // RANGES] for i in range(1, RANGES)}) if keys else []


def _sorted_runs(batches, cuts: list[bytes], length: int):
    """Sorted runs of entries (key, left side, windows), cut at the splitters.

    An entry is a stretch; a stretch of a wide group gives an entry for each window instead (no left side), and
    equal ones of a run are one entry, so that a string in a third of all texts gives each run one entry only.
    """
    entries: list[tuple[bytes, bytes, int, int, int]] = []
    size = 0

    def flush():
        entries.sort()
        fresh = [k == 0 or e[1] != b"" or e[:3] != entries[k - 1][:3] or e[2] != 1 for k, e in enumerate(entries)]
        which = np.cumsum(fresh) - 1
        kept = [e for e, f in zip(entries, fresh) if f]
        twice = np.bincount(which) > 1
        keys = [e[0] for e in kept]
        edges, name, out = [0, *[bisect_left(keys, c) for c in cuts], len(keys)], uuid.uuid4().hex, []
        for part, (a, z) in enumerate(zip(edges, edges[1:])):
            if z > a:
                x, y = np.searchsorted(which, [a, z])
                shape = np.array([[len(e[1]) for e in kept[a:z]], [e[2] for e in kept[a:z]]], np.uint16)
                out.append((name, part, z - a, front_code(keys[a:z]), zlib.compress(b"".join(e[1] for e in kept[a:z]), 1), shape.tobytes(), np.array([e[3] for e in entries[x:y]], np.int64).tobytes(), np.array([e[4] for e in entries[x:y]], np.int32).tobytes(), (which[x:y] - a).astype(np.int32).tobytes(), np.packbits(twice[a:z]).tobytes()))
        entries.clear()
        yield pd.DataFrame(out, columns=["run", "part", "count", "keys", "lefts", "shape", "uids", "starts", "which", "twice"])

    for b in batches:
        for uid, text, parts in zip(b["uid"], b["text"], b["parts"]):
            t = text.encode("utf-8", "surrogatepass")
            for p in parts:
                first, windows, left = p["first"], p["windows"], p["left"]
                if p["wide"]:
                    entries += [(t[i : i + length], b"", 1, uid, i) for i in range(first, first + windows)]
                else:
                    entries.append((t[first + left : first + windows - 1 + length], t[first : first + left], windows, uid, first))
            if len(entries) >= RUN:
                yield from flush()
    if entries:
        yield from flush()


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Texts are UTF-8 bytes, null as empty. Every byte that a string of ``length`` bytes covers which also starts
    elsewhere, in the same or another document, goes; repeated rows are documents of their own; other columns
    are ignored; an empty table gives no rows.
    """
    staged = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), "texts")
    spans = materialize(repeated_spans(staged.select("uid", "text"), length), "spans")
    n = spans.count()
    keys = spans.select(F.col("uid").alias("u"), "starts", "ends")
    touched = staged.join(maybe_broadcast(keys.select("u"), n, 16), F.col("uid") == F.col("u"), "left_semi").join(keys, F.col("uid") == F.col("u")).select("uid", "text", "starts", "ends")

    def cut(batches):
        for b in batches:
            rows = []
            for uid, text, starts, ends in zip(b["uid"], b["text"], b["starts"], b["ends"]):
                t = text.encode("utf-8", "surrogatepass")
                kept = b"".join(t[i:j] for i, j in zip([0, *ends], [*starts, len(t)]))
                rows.append((uid, len(t) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["u", "n_removed", "n_spans", "sha"])

    results = touched.mapInPandas(cut, "u long, n_removed long, n_spans long, sha string")
    base = staged.select("uid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    joined = base.join(results, F.col("uid") == F.col("u"), "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))
