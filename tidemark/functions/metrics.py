"""Losses and metrics as column expressions and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .ranges import running_before

# Names by which a metric can be asked for, in any letter case.
ALIASES = {"rmse": "rmse", "l2_root": "rmse", "root_mean_squared_error": "rmse", "mse": "rmse", "l2": "rmse", "mae": "mae", "l1": "mae", "mean_absolute_error": "mae", "logloss": "logloss", "log_loss": "logloss", "binary_logloss": "logloss", "binary": "logloss", "cross_entropy": "logloss", "auc": "auc", "roc_auc": "auc"}
# Objectives by the scale of their predictions.
PROBABILITY, RATE = ("binary", "cross_entropy", "xentropy"), ("poisson", "gamma", "tweedie")


def resolve(name, objective: str = "regression"):
    """The metric's own name; the objective's default for None; a callable as it is."""
    if callable(name):
        return name
    if name is None:
        return "logloss" if objective in PROBABILITY else "rmse"
    if str(name).lower() not in ALIASES:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(ALIASES)}, or a callable")
    return ALIASES[str(name).lower()]


def transform(objective: str, raw, sigmoid: float = 1.0):
    """Raw score (a column or an array) to prediction: a probability, a positive rate, or the score itself."""
    exp = F.exp if isinstance(raw, Column) else np.exp
    if objective in PROBABILITY:
        return 1 / (1 + exp(-raw * (sigmoid if objective == "binary" else 1.0)))
    return exp(raw) if objective in RATE else raw


def row_loss(metric, y, raw, objective: str = "regression", sigmoid: float = 1.0):
    """Loss of a row whose mean (for rmse: its root) is the metric, of columns or arrays; None for auc and callables.

    rmse and mae compare on the scale of predictions, logloss is taken from the raw score.
    """
    columns = isinstance(raw, Column)
    if metric == "rmse":
        gap = y - transform(objective, raw, sigmoid)
        return gap * gap
    if metric == "mae":
        return (F.abs if columns else np.abs)(y - transform(objective, raw, sigmoid))
    if metric == "logloss":
        z = raw * sigmoid if objective == "binary" else raw
        return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z if columns else np.logaddexp(0.0, z) - y * z
    return None


def auc(df: DataFrame, y: str, score: str, by: list[str] = []) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null for a single class.

    Rows are combined by score, and the scores of a group are summed by ranges, so no task holds a group.
    """
    counts = df.groupBy(*by, score).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1 - F.col(y).cast("double")).alias("neg"))
    ranked = running_before(counts, by, score, "neg", "neg_below")
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return ranked.groupBy(*by).agg(area.alias("auc"))


def auc_of(y: np.ndarray, score: np.ndarray) -> float | None:
    """The same of arrays."""
    values, at = np.unique(score, return_inverse=True)
    pos, neg = np.bincount(at, y, len(values)), np.bincount(at, 1 - y, len(values))
    both = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / both) if both else None


def evaluate(df: DataFrame, metric: str, y: str = "y", raw: str = "raw", by: list[str] = [], sigmoid: float = 1.0, objective: str = "regression") -> DataFrame:
    """The metric of each group as column ``value``."""
    if metric == "auc":
        return auc(df, y, raw, by).withColumnRenamed("auc", "value")
    mean = F.avg(row_loss(metric, F.col(y), F.col(raw), objective, sigmoid))
    return df.groupBy(*by).agg((F.sqrt(mean) if metric == "rmse" else mean).alias("value"))


def metric_of(metric, y: np.ndarray, raw: np.ndarray, objective: str = "regression", sigmoid: float = 1.0) -> float | None:
    """The metric of arrays; a callable gets labels and predictions."""
    if callable(metric):
        return float(metric(y, transform(objective, raw, sigmoid)))
    if metric == "auc":
        return auc_of(y, raw)
    mean = float(np.mean(row_loss(metric, y, raw, objective, sigmoid)))
    return mean**0.5 if metric == "rmse" else mean


def z_gate(d: Column) -> list[Column]:
    """Aggregates for a paired test: mean, sample standard deviation and count of the differences."""
    return [F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n")]


def passes(mean: float | None, sd: float | None, n: int, z: float) -> bool:
    """Whether the mean difference is below zero by more than ``z`` standard errors."""
    return mean is not None and mean < 0 and mean < -z * (sd or 0.0) / max(1, n) ** 0.5


def r2(y: Column, pred: Column, w: Column | None = None) -> Column:
    w = F.lit(1.0) if w is None else w
    total = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    return 1 - F.sum(w * (y - pred) * (y - pred)) / F.nullif(total, F.lit(0.0))
