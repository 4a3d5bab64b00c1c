"""A boosted ensemble as a table of nodes: scoring, leave-one-out contributions, ranking and retirement of trees."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import metrics as M
from ..functions.prep import finite

NODE_SCHEMA = "tree_id int, node_id int, is_leaf boolean, feature string, threshold double, left int, right int, gain double, value double, missing_left boolean"


#: Nodes up to which an ensemble is evaluated as columns, and trees of one leave-one-out aggregate.
JVM_NODES, LOO_COLUMNS = 512, 64


class DriftWarning(UserWarning):
    """Warnings of this library."""


def total(outputs: np.ndarray) -> np.ndarray:
    """Sums over the trees, one after the other as tables add them, so that ties of scores are the same."""
    out = np.zeros(len(outputs))
    for t in range(outputs.shape[1]):
        out += outputs[:, t]
    return out


@dataclass(frozen=True)
class Ensemble:
    """Ordered trees; a tree is a list of node tuples (is_leaf, feature, threshold, left, right, gain, value, missing_left).

    The raw score is the sum of the trees' leaf values. Immutable: surgery gives a new ensemble.
    """

    features: tuple[str, ...]
    trees: tuple[tuple, ...] = ()
    objective: str = "regression"
    sigmoid: float = 1.0

    def __len__(self) -> int:
        return len(self.trees)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, n[0], n[1], n[2], n[3], n[4], n[5], n[6], n[7]) for t, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @classmethod
    def from_frame(cls, nodes: DataFrame, features: list[str], objective: str = "regression", sigmoid: float = 1.0) -> "Ensemble":
        trees: dict[int, list] = {}
        for r in nodes.orderBy("tree_id", "node_id").collect():
            trees.setdefault(r["tree_id"], []).append(tuple(r)[2:])
        return cls(tuple(features), tuple(tuple(trees[k]) for k in sorted(trees)), objective, sigmoid)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf values; missing values are NaN."""
        place = {f: i for i, f in enumerate(self.features)}
        out = np.zeros((len(x), len(self.trees)))
        for t, tree in enumerate(self.trees):
            stack = [(0, np.arange(len(x)))]
            while stack:
                i, rows = stack.pop()
                leaf, feature, threshold, left, right, _, value, missing_left = tree[i]
                if leaf:
                    out[rows, t] = value
                elif len(rows):
                    v = x[rows, place[feature]]
                    go = np.where(np.isnan(v), missing_left, v <= threshold)
                    stack += [(left, rows[go]), (right, rows[~go])]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return total(self.outputs(x))

    def keep(self, ids: list[int]) -> "Ensemble":
        return replace(self, trees=tuple(self.trees[i] for i in ids))

    def importance(self, kind: str = "gain", trees: list[int] | None = None) -> dict[str, float]:
        out = dict.fromkeys(self.features, 0.0)
        for t in range(len(self)) if trees is None else trees:
            for n in self.trees[t]:
                if not n[0]:
                    out[n[1]] += n[5] if kind == "gain" else 1
        return out


def ensemble_of(model) -> Ensemble:
    """The Ensemble itself, that of a table of nodes, or of a fitted model (``ensemble_``); checked to be a sum of trees."""
    if isinstance(model, DataFrame):
        names = [r["feature"] for r in model.where(~F.col("is_leaf")).groupBy("feature").agg(F.min(F.struct("tree_id", "node_id")).alias("at")).orderBy("at").collect()]
        model = Ensemble.from_frame(model, names)
    found = model if isinstance(model, Ensemble) else getattr(model, "ensemble_", None)
    if not isinstance(found, Ensemble):
        raise TypeError("an Ensemble, a table of nodes or a fitted model is needed")
    if found.objective in ("multiclass", "multiclassova"):
        raise NotImplementedError("one output a row only")
    for t, tree in enumerate(found.trees):
        inner = [n for n in tree if not n[0]]
        below = sorted(c for n in inner for c in n[3:5])
        if below != list(range(1, len(tree))) or any(n[1] not in found.features for n in inner):
            raise ValueError(f"tree {t} is not one tree over the ensemble's features")
    return found


def tree_column(tree: tuple, values: dict[str, Column] | None = None, node: int = 0) -> Column:
    """A tree as a column: nested conditions, missing values as the node says."""
    leaf, feature, threshold, left, right, _, value, missing_left = tree[node]
    if leaf:
        return F.lit(float(value))
    x = finite(F.col(f"`{feature}`")) if values is None else values[feature]
    goes_left = F.coalesce(x <= F.lit(float(threshold)), F.lit(bool(missing_left)))
    return F.when(goes_left, tree_column(tree, values, left)).otherwise(tree_column(tree, values, right))


def with_raw(df: DataFrame, ensemble: Ensemble, out: str = "raw", per_tree: str | None = None) -> DataFrame:
    """``df`` with the raw score, or with the array of all trees' outputs.

    A small ensemble is columns in the JVM; one of more than JVM_NODES nodes is broadcast to Arrow batches (its size
    is set by parameters, not by the data).
    """
    if sum(map(len, ensemble.trees)) <= JVM_NODES:
        trees = [tree_column(t) for t in ensemble.trees]
        return df.withColumn(per_tree, F.array(*trees) if trees else F.array().cast("array<double>")) if per_tree else df.withColumn(out, sum(trees, F.lit(0.0)))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((ensemble.features, ensemble.trees))
    x = F.array(*[F.coalesce(finite(F.col(f"`{f}`")), F.lit(float("nan"))) for f in ensemble.features])

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(Ensemble(*shared.value).raw(np.stack(values.to_numpy())) if len(values) else [], dtype="float64")

    @F.pandas_udf("array<double>")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series(list(Ensemble(*shared.value).outputs(np.stack(values.to_numpy()))) if len(values) else [])

    return df.withColumn(per_tree, each(x)) if per_tree else df.withColumn(out, score(x))


def loo_scores(outputs: DataFrame, metric: str, y: str = "y", sigmoid: float = 1.0, objective: str = "regression", n_trees: int | None = None) -> DataFrame:
    """(tree_id, score): how much worse the metric gets without the tree; positive is helpful.

    outputs: rows with ``y`` and array ``out`` of the trees' outputs. For a metric that is a mean over rows it is one
    aggregate with a column a tree, LOO_COLUMNS of them at a time; for auc rows are combined by tree and score.
    """
    spark = outputs.sparkSession
    if n_trees is None:
        n_trees = outputs.select(F.max(F.size("out"))).first()[0] or 0
    full = outputs.select(F.col(y).cast("double").alias("y"), "out", F.aggregate("out", F.lit(0.0), lambda a, v: a + v).alias("raw"))
    if metric == "auc":
        each = full.select("y", F.posexplode(F.concat(F.array(F.lit(0.0)), "out")).alias("t", "o"), "raw").select("t", "y", (F.col("raw") - F.col("o")).alias("raw"))
        got = {r["t"]: r["value"] for r in M.evaluate(each, metric, "y", "raw", ["t"]).collect()}
        return spark.createDataFrame([(t, got[0] - got[t + 1] if got.get(0) is not None else None) for t in range(n_trees)], "tree_id int, score double")
    root = math.sqrt if metric == "rmse" else float
    loss = lambda raw: F.avg(M.row_loss(metric, F.col("y"), raw, objective, sigmoid))
    values: list[float | None] = []
    for a in range(0, max(1, n_trees), LOO_COLUMNS):
        some = range(a, min(n_trees, a + LOO_COLUMNS))
        values += full.agg(*([loss(F.col("raw")).alias("b")] if not a else []), *[loss(F.col("raw") - F.get("out", F.lit(t))).alias(f"t{t}") for t in some]).first()
    base, *without = [None if v is None else root(v) for v in values]
    return spark.createDataFrame([(t, v - base if v is not None else None) for t, v in enumerate(without)], "tree_id int, score double")


def retire_nodes(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """The node table without the removed trees, renumbered densely in order."""
    kept = nodes.join(F.broadcast(removed.select("tree_id")), "tree_id", "left_anti")
    ids = kept.select("tree_id").distinct().collect()  # one row a tree
    table = nodes.sparkSession.createDataFrame([(r, i) for i, r in enumerate(sorted(x["tree_id"] for x in ids))], "tree_id int, new_id int")
    return kept.join(F.broadcast(table), "tree_id").drop("tree_id").withColumnRenamed("new_id", "tree_id").select(*nodes.columns)


@dataclass
class TreeManager:
    """Scores the trees of an ensemble on validation rows and selects trees to retire.

    ``ensemble`` is an Ensemble, a table of nodes (its features in order of appearance, objective regression), or
    anything fitted that has one as ``ensemble_``.
    """

    ensemble: object | None = None
    max_retire_fraction: float = 0.5
    scores: list[float] | None = None
    metric: object | None = None
    baseline: float | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.max_retire_fraction <= 1:
            raise ValueError("max_retire_fraction must lie in [0, 1]")
        self.ensemble = None if self.ensemble is None else ensemble_of(self.ensemble)
        self._rows = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}

    def _scored(self) -> list[float]:
        if self.scores is None:
            raise RuntimeError("call score_trees first")
        return self.scores

    def score_trees(self, rows, y: str = "y", metric=None, ensemble=None) -> list[float]:
        """Leave-one-out contribution of each tree; a callable metric f(y, prediction) is a loss.

        rows: a DataFrame with the features and ``y``, or rows of ``operators.rows``.
        """
        from .rows import rows_of

        model = self.ensemble if ensemble is None else ensemble_of(ensemble)
        if model is None:
            raise TypeError("an Ensemble is needed")
        metric = M.resolve(metric, model.objective)
        held = rows_of(rows, list(model.features), y) if isinstance(rows, DataFrame) else rows
        if metric in ("auc", "logloss"):
            low, high = held.label_range()
            if low is not None and (low < 0 or high > 1):
                raise ValueError("labels must lie in [0, 1]")
            if metric == "auc" and low == high:
                raise ValueError("auc needs both classes")
        self.ensemble, self.metric, self._rows = model, metric, held
        self.baseline, self.scores = held.leave_one_out(model, metric)
        return self.scores

    def ranking(self) -> list[int]:
        s = self._scored()
        return sorted(range(len(s)), key=lambda i: -s[i])

    def identify_retiring(self, threshold: float = 0.0) -> list[int]:
        s = self._scored()
        return sorted((i for i in range(len(s)) if s[i] < threshold), key=lambda i: s[i])

    def lowest_scoring(self, n: int, exclude: tuple[int, ...] | list[int] = ()) -> list[int]:
        s, out = self._scored(), set(exclude)
        return sorted((i for i in range(len(s)) if i not in out), key=lambda i: s[i])[: max(0, n)]

    def select_retirement(self, threshold: float = 0.0, max_fraction: float | None = None, max_count: int | None = None, greedy: bool = True, min_z: float = 0.0) -> list[int]:
        """Trees below the threshold; greedily, a tree goes only if its removal helps on top of those removed before.

        With min_z the paired row losses must improve by min_z standard errors; auc and callables have none, and must
        strictly improve.
        """
        candidates = self.identify_retiring(threshold)
        share = self.max_retire_fraction if max_fraction is None else max_fraction
        cap = math.floor(share * len(self._scored()))
        cap = max(0, cap if max_count is None else min(cap, int(max_count)))
        if not greedy or not candidates or not cap:
            return candidates[:cap]
        if self._rows is None:
            raise RuntimeError("the scored rows are gone; call score_trees first")
        taken: list[int] = []
        for c, better in self._rows.removals(self.ensemble, candidates, self.metric, min_z):
            if better:
                taken.append(c)
                if len(taken) >= cap:
                    break
        return taken

    def retire_trees(self, indices: list[int], ensemble: Ensemble | None = None) -> Ensemble:
        """A new ensemble without the trees, at most max_retire_fraction of them, in the order given."""
        model = self.ensemble if ensemble is None else ensemble_of(ensemble)
        ids = list(indices)
        if len(set(ids)) != len(ids) or any(not 0 <= i < len(model) for i in ids):
            raise ValueError("tree indices must be distinct and in range")
        cap = math.floor(self.max_retire_fraction * len(model))
        if len(ids) > cap:
            warnings.warn(f"only {cap} of {len(ids)} trees are retired", DriftWarning, stacklevel=2)
            ids = ids[:cap]
        gone = set(ids)
        return model.keep([i for i in range(len(model)) if i not in gone])


def per_tree_importance(nodes: DataFrame) -> DataFrame:
    """(tree_id, feature, gain, splits) of the inner nodes."""
    return nodes.where(~F.col("is_leaf")).groupBy("tree_id", "feature").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
