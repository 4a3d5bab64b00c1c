"""Histogram gradient boosting, leaf by leaf: on arrays, and on tables of any size with the same trees.

On a table the histograms of all open leaves are one aggregate with map-side combine; only (leaves x features x bins)
sums reach the driver, which chooses the splits.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metrics as M
from ..functions.prep import clean, finite
from ..functions.tables import pandas_of, written
from .drift import order_statistics
from .ensemble import Ensemble, tree_column, with_raw


@dataclass(frozen=True)
class BoostParams:
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_bin: int = 255
    min_data_in_leaf: int = 20
    lambda_l2: float = 0.0
    min_gain: float = 1e-12
    sigmoid: float = 1.0
    max_depth: int = -1


def cut_points(values: np.ndarray) -> np.ndarray:
    """Upper bounds of a feature's bins from its distinct values, if those are few enough to have a bin each."""
    return (values[1:] + values[:-1]) / 2 if len(values) > 1 else np.empty(0)


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Upper bounds of each feature's bins: midpoints of distinct values if they are few, else quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, j]), j])
        distinct = v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v
        if len(distinct) <= most:
            out.append(cut_points(distinct))
        else:
            pos = np.arange(1, most) / most * (len(v) - 1)
            lo = pos.astype(np.int64)
            out.append(np.unique(v[lo] + (pos - lo) * (v[np.minimum(lo + 1, len(v) - 1)] - v[lo])))
    return out


def frame_bins(df: DataFrame, features: list[str], most: int) -> list[np.ndarray]:
    """The same of a table: features with few values by their values, all others by exact order statistics."""
    x = clean(df, features).toDF(*[f"x{i}" for i in range(len(features))])
    about = x.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(x.columns)], *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(x.columns)]).first()
    few = [i for i in range(len(features)) if about[f"d{i}"] <= 2 * most]
    values: dict[int, np.ndarray] = {}
    if few:  # some 2 * most values a feature
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in few])).alias("c")
        found = pandas_of(x.select(cells).select("c.*").where("v IS NOT NULL").distinct())
        values = {i: np.sort(found["v"][found["i"] == i].to_numpy()) for i in few}
    out: list[np.ndarray] = [np.empty(0)] * len(features)
    ranks: dict[str, list[int]] = {}
    for i in range(len(features)):
        if i in values and len(values[i]) <= most:
            out[i] = cut_points(values[i])
        elif about[f"n{i}"]:
            pos = np.arange(1, most) / most * (about[f"n{i}"] - 1)
            ranks[f"x{i}"] = [int(r) for p in pos.astype(np.int64) for r in (p, min(p + 1, about[f"n{i}"] - 1))]
    for name, at in order_statistics(x, ranks).items():
        i = int(name[1:])
        pos = np.arange(1, most) / most * (about[f"n{i}"] - 1)
        lo = pos.astype(np.int64)
        low, high = (np.array([at[int(r)] for r in rs]) for rs in (lo, np.minimum(lo + 1, about[f"n{i}"] - 1)))
        out[i] = np.unique(low + (pos - lo) * (high - low))
    return out


def best_split(hist: tuple[np.ndarray, ...], bounds: list[np.ndarray], p: BoostParams) -> tuple[float, int, int, bool]:
    """(gain, feature, bin, missing values go left) of the best split of a leaf; feature -1 if there is none.

    hist: sums of gradients, hessians and rows, each (features, bins); the last bin holds missing values.
    """
    g, h, c = hist
    total_g, total_h, total_c = (v[0].sum() for v in hist)
    score = lambda a, b: a * a / np.maximum(b + p.lambda_l2, 1e-12)
    found = (p.min_gain, -1, 0, False)
    inside = np.arange(g.shape[1] - 2)[None, :] < np.array([len(b) for b in bounds])[:, None]
    cg, ch, cc = (np.cumsum(v[:, :-1], axis=1)[:, :-1] for v in hist)
    for missing_left in (False, True):
        if missing_left and not c[:, -1].any():
            continue
        lg, lh, lc = (cum + (v[:, -1:] if missing_left else 0) for cum, v in zip((cg, ch, cc), (g, h, c)))
        gain = score(lg, lh) + score(total_g - lg, total_h - lh) - score(total_g, total_h)
        gain = np.where(inside & (lc >= p.min_data_in_leaf) & (total_c - lc >= p.min_data_in_leaf), gain, -np.inf)
        at = int(np.argmax(gain)) if gain.size else 0
        if gain.size and gain.flat[at] > found[0]:
            found = (float(gain.flat[at]), *(int(k) for k in divmod(at, gain.shape[1])), missing_left)
    return found


class Growth:
    """A tree that grows best leaf first; whoever grows it supplies the histograms of the leaves.

    ``nodes`` are (is leaf, feature number, bin, left, right, gain, value, missing left).
    """

    def __init__(self, bounds: list[np.ndarray], params: BoostParams, root: tuple[np.ndarray, ...]) -> None:
        self.bounds, self.p = bounds, params
        self.nodes: list[list] = []
        self.depth: list[int] = []
        self.queue: list = []
        self.leaves = 0
        self._leaf(root, 0)

    def _leaf(self, hist, depth: int) -> int:
        i = len(self.nodes)
        total_g, total_h = hist[0][0].sum(), hist[1][0].sum()
        value = -total_g / max(total_h + self.p.lambda_l2, 1e-12) * self.p.learning_rate
        self.nodes.append([True, -1, 0, 0, 0, 0.0, float(value), False])
        self.depth.append(depth)
        self.leaves += 1
        gain, j, k, missing_left = best_split(hist, self.bounds, self.p)
        if j >= 0 and (self.p.max_depth < 0 or depth < self.p.max_depth):
            heapq.heappush(self.queue, (-gain, i, j, k, missing_left))
        return i

    def next(self) -> tuple | None:
        """The leaf to split next: (-gain, node, feature, bin, missing left)."""
        return self.queue[0] if self.queue and self.leaves < self.p.num_leaves else None

    def coming(self) -> list[tuple]:
        """The leaves that may be split before the tree is full, best first."""
        return sorted(self.queue)[: max(0, self.p.num_leaves - self.leaves)]

    def split(self, left, right) -> tuple[int, int]:
        """Split the next leaf, given the histograms of its two sides."""
        gain, i, j, k, missing_left = heapq.heappop(self.queue)
        self.leaves -= 1
        a, b = (self._leaf(h, self.depth[i] + 1) for h in (left, right))
        self.nodes[i] = [False, j, k, a, b, -gain, 0.0, missing_left]
        return a, b

    def tree(self, names: list[str], start: float = 0.0) -> tuple:
        """The nodes as an Ensemble has them, with ``start`` added to the leaves."""
        return tuple((True, None, 0.0, 0, 0, 0.0, n[6] + start, False) if n[0] else (False, names[n[1]], float(self.bounds[n[1]][n[2]]), n[3], n[4], n[5], 0.0, n[7]) for n in self.nodes)


def _grow_arrays(codes: np.ndarray, bounds: list[np.ndarray], params: BoostParams, g: np.ndarray, h: np.ndarray, width: int) -> tuple[Growth, np.ndarray]:
    """A tree on binned rows, and what it adds to each row. codes: (rows, features), feature j's from j * width on."""
    features = codes.shape[1]
    even = bool((h == h[0]).all()) if len(h) else True

    def histogram(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        flat = codes[rows].ravel()
        size = features * width
        shaped = lambda v: v.reshape(features, width)
        c = np.bincount(flat, minlength=size)
        sg = np.bincount(flat, np.repeat(g[rows], features), size)
        sh = c * h[0] if even else np.bincount(flat, np.repeat(h[rows], features), size)
        return shaped(sg), shaped(sh), shaped(c)

    rows = {0: np.arange(len(g))}
    hists = {0: histogram(rows[0])}
    growth = Growth(bounds, params, hists[0])
    while (leaf := growth.next()) is not None:
        _, i, j, k, missing_left = leaf
        mine = rows.pop(i)
        code = codes[mine, j] - j * width
        go = np.where(code == width - 1, missing_left, code <= k)
        small = histogram(mine[go] if go.sum() * 2 <= len(go) else mine[~go])
        large = tuple(a - b for a, b in zip(hists.pop(i), small))
        sides = (small, large) if go.sum() * 2 <= len(go) else (large, small)
        a, b = growth.split(*sides)
        rows[a], rows[b], hists[a], hists[b] = mine[go], mine[~go], *sides
    delta = np.zeros(len(g))
    for i, mine in rows.items():
        delta[mine] = growth.nodes[i][6]
    return growth, delta


def _slopes(objective: str, sigmoid: float, raw, y, w):
    """Gradients and hessians of columns or arrays."""
    if objective in M.PROBABILITY:
        s = sigmoid if objective == "binary" else 1.0
        p = M.transform(objective, raw, sigmoid)
        spread = p * (1 - p)
        return w * s * (p - y), w * s * s * (F.greatest(spread, F.lit(1e-16)) if isinstance(spread, Column) else np.maximum(spread, 1e-16))
    return w * (raw - y), w * 1.0


def _start(objective: str, sigmoid: float, mean: float) -> float:
    """The raw score of all rows before the first tree."""
    if objective not in M.PROBABILITY:
        return mean
    p = min(max(mean, 1e-15), 1 - 1e-15)
    return math.log(p / (1 - p)) / (sigmoid if objective == "binary" else 1.0)


class _Patience:
    """Stops when the loss of evaluation rows has not fallen for some rounds."""

    def __init__(self, rounds: int | None, first: int) -> None:
        self.rounds, self.best, self.at = rounds, math.inf, first

    def over(self, loss: float, trees: int) -> bool:
        if loss < self.best:
            self.best, self.at = loss, trees
            return False
        return bool(self.rounds) and trees - self.at >= self.rounds


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, base: Ensemble, rounds: int, params: BoostParams, x_eval=None, y_eval=None, patience: int | None = None, bounds: list[np.ndarray] | None = None) -> Ensemble:
    """``base`` with ``rounds`` more trees; bins are made afresh from these rows unless given. The first tree of all carries the mean score.

    With evaluation rows and patience, stops when the loss has not fallen for that many rounds, and keeps the best.
    """
    if rounds <= 0 or not len(x):
        return base
    bounds = _bins(x, params.max_bin - 1) if bounds is None else bounds
    width = max((len(b) for b in bounds), default=0) + 2
    codes = np.stack([np.where(np.isnan(x[:, j]), width - 1, np.searchsorted(b, x[:, j], side="left")) + j * width for j, b in enumerate(bounds)], axis=1).astype(np.int32)
    names, trees, start = list(base.features), list(base.trees), 0.0
    raw = base.raw(x)
    if not trees:
        start = _start(base.objective, base.sigmoid, float(np.average(y, weights=w)))
        raw = raw + start
    metric, stop = M.resolve(None, base.objective), _Patience(patience, len(trees))
    raw_eval = base.raw(x_eval) if x_eval is not None else None
    for _ in range(rounds):
        growth, delta = _grow_arrays(codes, bounds, params, *_slopes(base.objective, base.sigmoid, raw, y, w), width)
        trees.append(growth.tree(names, 0.0 if trees else start))
        raw = raw + delta
        if raw_eval is not None:
            raw_eval = raw_eval + replace(base, trees=trees[-1:]).raw(x_eval)
            if stop.over(M.metric_of(metric, y_eval, raw_eval, base.objective, base.sigmoid), len(trees)):
                break
    return replace(base, trees=tuple(trees[: stop.at] if raw_eval is not None and patience else trees))


def _code_column(growth: Growth, leaf, width: int, node: int = 0) -> Column:
    """What ``leaf`` says of the leaf that a row of codes (array ``codes``) falls in; nulls where it says None."""
    is_leaf, j, k, left, right, _, _, missing_left = growth.nodes[node]
    if is_leaf:
        return leaf(node)
    return F.when(_left_of(j, k, missing_left, width), _code_column(growth, leaf, width, left)).otherwise(_code_column(growth, leaf, width, right))


def _left_of(j: int, k: int, missing_left: bool, width: int) -> Column:
    code = F.get("codes", F.lit(j))
    return (code <= k) | (code == width - 1) if missing_left else code <= k


def boost_frame(df: DataFrame, base: Ensemble, rounds: int, params: BoostParams, eval_df: DataFrame | None = None, patience: int | None = None, bounds: list[np.ndarray] | None = None, every: int = 8) -> Ensemble:
    """The same as ``boost`` on rows (features, y, optionally w) of any number.

    Rows are binned once into a written table. A pass of a tree sums gradients, hessians and rows by (leaf, feature,
    bin) for both sides of all splits that may still come, so a tree takes about as many passes as it is deep. The
    raw scores are written again after ``every`` trees, which keeps plans short.
    """
    features = list(base.features)
    w = F.col("w").cast("double") if "w" in df.columns else F.lit(1.0)
    n = df.count()
    if rounds <= 0 or not n:
        return base
    bounds = frame_bins(df, features, params.max_bin - 1) if bounds is None else bounds
    width = max((len(b) for b in bounds), default=0) + 2
    scored = with_raw(df.withColumn("_w", F.coalesce(w, F.lit(1.0))), base, "raw").select("raw", F.col("y").cast("double").alias("y"), F.col("_w").alias("w"), *[finite(F.col(f"`{f}`")).alias(f"x{i}") for i, f in enumerate(features)])
    # As many bounds lie below a value as edges just above the bounds lie at or below it.
    edges = [[-math.inf, *(math.nextafter(float(c), math.inf) for c in b), math.inf] if len(b) else [-math.inf, 0.0, math.inf] for b in bounds]
    cut = Bucketizer(splitsArray=edges, inputCols=[f"x{i}" for i in range(len(features))], outputCols=[f"c{i}" for i in range(len(features))], handleInvalid="keep").transform(scored)
    codes = F.array(*[F.when(F.col(f"x{i}").isNull(), width - 1).otherwise(F.col(f"c{i}").cast("int") if len(bounds[i]) else F.lit(0)).cast("short") for i in range(len(features))])
    rows = written(cut.select("raw", "y", "w", codes.alias("codes")), "codes")
    trees, start = list(base.trees), 0.0
    if not trees:
        mean = rows.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
        start = _start(base.objective, base.sigmoid, mean)
        rows = rows.withColumn("raw", F.col("raw") + start)
    metric, stop = M.resolve(None, base.objective), _Patience(patience, len(trees))
    held = with_raw(eval_df, base, "_raw") if eval_df is not None else None
    for done in range(1, rounds + 1):
        g, h = _slopes(base.objective, base.sigmoid, F.col("raw"), F.col("y"), F.col("w"))
        sloped = rows.select("codes", g.alias("g"), h.alias("h"))

        def histograms(label: Column) -> dict[int, tuple[np.ndarray, ...]]:
            cells = sloped.withColumn("label", label).where("label IS NOT NULL").select("label", "g", "h", F.posexplode("codes").alias("j", "code"))
            sums = pandas_of(cells.groupBy("label", "j", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("c")))
            out = {}
            for k, mine in sums.groupby("label"):
                hist = tuple(np.zeros((len(features), width)) for _ in range(3))
                for table, column in zip(hist, ("g", "h", "c")):
                    table[mine["j"], mine["code"]] = mine[column]
                out[int(k)] = hist
            return out

        growth = Growth(bounds, params, histograms(F.lit(0))[0])
        known: dict[int, tuple] = {}
        while (leaf := growth.next()) is not None:
            if leaf[1] not in known:
                ahead = {i: (j, k, m) for _, i, j, k, m in growth.coming() if i not in known}
                side = lambda i: F.when(_left_of(*ahead[i], width), F.lit(2 * i)).otherwise(F.lit(2 * i + 1)) if i in ahead else F.lit(None).cast("int")
                got = histograms(_code_column(growth, side, width))
                known |= {i: (got[2 * i], got[2 * i + 1]) for i in ahead}
            growth.split(*known.pop(leaf[1]))
        trees.append(growth.tree(features, 0.0 if trees else start))
        rows = rows.withColumn("raw", F.col("raw") + _code_column(growth, lambda i: F.lit(growth.nodes[i][6]), width))
        if held is not None:
            held = held.withColumn("_raw", F.col("_raw") + tree_column(trees[-1]))
            loss = M.evaluate(held, metric, "y", "_raw", [], base.sigmoid, base.objective).first()["value"]
            if stop.over(loss, len(trees)):
                break
        if done % every == 0 and done < rounds:
            rows = written(rows, "codes")
            held = written(held, "held") if held is not None else None
    return replace(base, trees=tuple(trees[: stop.at] if held is not None and patience else trees))
