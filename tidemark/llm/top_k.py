"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialize

SCALE = 1024.0
#: Vectors of a candidate block and of a query chunk; a unit of work holds one of each.
BLOCK, CHUNK = 8192, 1024
_LEAST, _MOST, _LOW = -(1 << 63), (1 << 63) - 1, (1 << 62) - 1


def threshold_top_k(lists: np.ndarray, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int, int]]:
    """(score, vec_id, row) of the k best rows, ties to the smaller id; rows whose uid is ``own`` take no part.

    lists: per dimension the rows by ascending component. Sorted access goes down every list from the end the
    query's sign prefers; rows met are scored by random access. As no row not yet met can score above the
    inner product of the query with the components at the present depth, the search ends as soon as that
    bound is below the kth score (at equality it goes on, for ties).
    """
    n = len(vectors)
    dims = np.flatnonzero(query)
    seen = np.zeros(n, dtype=bool)
    seen[uids == own] = True
    left, depth, step = n - int(seen.sum()), 0, max(4, k)
    best_s, best_i, best_r = np.empty(0, vectors.dtype), np.empty(0, np.int64), np.empty(0, np.int64)
    while left and depth < n:
        end = min(n, depth + step)
        if len(dims):
            down = query[dims] > 0
            met = np.where(down, lists[n - end : n - depth, dims][::-1], lists[depth:end, dims])
            rows = np.unique(met)
            rows = rows[~seen[rows]]
        else:
            rows, end = np.flatnonzero(~seen), n
        seen[rows] = True
        left -= len(rows)
        s = np.concatenate([best_s, vectors[rows] @ query])
        i, r = np.concatenate([best_i, ids[rows]]), np.concatenate([best_r, rows])
        if len(s) > 4 * k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= cut
            s, i, r = s[keep], i[keep], r[keep]
        order = np.lexsort((r, i, -s))[:k]
        best_s, best_i, best_r = s[order], i[order], r[order]
        depth, step = end, step * 2
        if len(best_s) == k and len(dims) and depth < n:
            edge = np.where(down, lists[n - depth, dims], lists[depth - 1, dims])
            if query[dims] @ vectors[edge, dims] < best_s[-1]:
                break
    return [(int(a), int(b), int(c)) for a, b, c in zip(best_s, best_i, best_r)]


def _matrix(arrays: pd.Series) -> np.ndarray:
    """Whole numbers as float64 while every product and sum stays exact, else as Python integers."""
    m = np.floor(np.stack(arrays.to_numpy()).astype("float64") * SCALE)
    top = float(np.abs(m).max()) if m.size else 0.0
    return m if top * top * m.shape[1] < 2.0**52 else np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)


def exact_top_k(embeddings: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best other rows.

    A component x counts as floor(1024 x). Vectors that are null, empty or hold a null or non-finite component
    take no part, nor do rows with a null id; only vectors of the query's length are its candidates. Of
    repeated ids each row counts by itself and a query leaves out its own row only. Scores are
    compared with 126 bits, and given as the nearest 64-bit number. Other columns are ignored, whatever their names; an empty table gives no rows.
    Candidates lie in blocks of about 8192 rows and queries in chunks; a
    unit of work is one block with one chunk, holds its own sorted lists and gives k rows a query.
    """
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    base = embeddings.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    base = materialize(base.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("uid")), "vectors")
    n, n_queries = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // CHUNK))
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), F.col("uid")), F.lit(parts)).cast("int")
    others = F.sequence(F.lit(0), F.lit(chunks - 1))
    rows = base.select(F.size("v").alias("dim"), deal(1, blocks).alias("block"), F.explode(others).alias("chunk"), "uid", "vec_id", "v")
    # Under names of their own, so that the two sides of the cogroup share no column.
    queries = base.where(F.col("vec_id") % every == 0).select(F.size("v").alias("q_dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q_block"), deal(2, chunks).alias("q_chunk"), F.col("uid").alias("own"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def unit(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(asked):
            some = some.sort_values(["vec_id", "uid"], ignore_index=True)
            x, q = _matrix(some["v"]), _matrix(asked["q"])
            if x.dtype != q.dtype:
                x, q = x.astype(object), q.astype(object)
                x, q = (np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape) for m in (x, q))
            lists = np.argsort(x, axis=0, kind="stable")
            ids, uids = some["vec_id"].to_numpy(), some["uid"].to_numpy()
            for own, name, vector in zip(asked["own"].to_numpy(), asked["query_id"].to_numpy(), q):
                out += [(own, name, i, uids[r], min(max(s >> 62, _LEAST), _MOST), s & _LOW) for s, i, r in threshold_top_k(lists, x, ids, uids, vector, own, k)]
        return pd.DataFrame(out, columns=["own", "query_id", "vec_id", "uid", "high", "low"]).astype("int64")

    found = rows.groupBy("dim", "block", "chunk").cogroup(queries.groupBy("q_dim", "q_block", "q_chunk")).applyInPandas(unit, "own long, query_id long, vec_id long, uid long, high long, low long")
    best = Window.partitionBy("own").orderBy(F.desc("high"), F.desc("low"), "vec_id", "uid")
    score = F.when(F.col("high") > 1, F.lit(_MOST)).when(F.col("high") < -2, F.lit(_LEAST)).otherwise(F.col("high") * F.lit(1 << 61) * 2 + F.col("low"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
