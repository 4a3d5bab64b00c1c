"""Batches of labelled rows: as arrays while they are small, as tables beyond, with the same answers.

The reference for what a batch has to answer is ``Rows``: losses of ensembles, leave-one-out scores, the paired
comparison of two ensembles, greedy removals, a walk-forward split, a sample, and boosting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import metrics as M
from ..functions.prep import finite
from ..functions.tables import frame_of, pandas_of, written
from .ensemble import Ensemble, loo_scores, total, with_raw
from .trainer import BoostParams, boost, boost_frame, frame_bins, _bins

#: Cells (rows x (features + 2)) up to which a batch is arrays on the driver: 128 MB.
LOCAL_CELLS = 1 << 24
#: Rows that a callable metric is given of a table; a hash of the row chooses them.
CALLABLE_ROWS = 1 << 20


def rows_of(df: DataFrame, features: list[str], y: str = "y", w: str | None = None, order: str | None = None, limit: int | None = None) -> "LocalRows | TableRows":
    """Rows with the features (missing values as null), ``y``, ``w`` (1 if absent) and their place in time.

    Without an order column, rows go by what they hold, which doesn't change with the partitioning.
    """
    limit = LOCAL_CELLS if limit is None else limit
    cells = [finite(F.col(f"`{f}`")).alias(f"x{i}") for i, f in enumerate(features)]
    weight = F.coalesce(F.col(f"`{w}`").cast("double"), F.lit(1.0)) if w else F.lit(1.0)
    label = F.col(f"`{y}`").cast("double")
    tie = F.xxhash64(*[F.col(f"`{f}`") for f in features], F.col(f"`{y}`"))
    slim = df.select(*cells, label.alias("y"), weight.alias("w"), (F.col(f"`{order}`") if order else F.lit(0)).alias("o"), tie.alias("h"))
    n = df.count()
    if n * (len(features) + 2) <= limit:
        got = pandas_of(slim).sort_values(["o", "h"], kind="stable", na_position="first")
        x = got[[f"x{i}" for i in range(len(features))]].to_numpy("float64") if features else np.empty((n, 0))
        return LocalRows(list(features), x, got["y"].to_numpy("float64"), got["w"].to_numpy("float64"), got["h"].to_numpy("int64"))
    return TableRows(list(features), written(slim, "rows"), n)


@dataclass
class LocalRows:
    """A batch as arrays, in the order of time."""

    features: list[str]
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray

    @property
    def n(self) -> int:
        return len(self.y)

    def label_range(self) -> tuple[float | None, float | None]:
        return (float(self.y.min()), float(self.y.max())) if self.n else (None, None)

    def loss(self, model: Ensemble, metric) -> float:
        v = M.metric_of(metric, self.y, model.raw(self.x), model.objective, model.sigmoid) if self.n else None
        return math.nan if v is None else 1 - v if metric == "auc" else v

    def leave_one_out(self, model: Ensemble, metric) -> tuple[float | None, list[float]]:
        if not len(model):
            return (M.metric_of(metric, self.y, np.zeros(self.n), model.objective, model.sigmoid) if self.n else None), []
        out = model.outputs(self.x)
        full = total(out)
        value = lambda raw: M.metric_of(metric, self.y, raw, model.objective, model.sigmoid)
        base, sign = value(full), -1.0 if metric == "auc" else 1.0
        return base, [sign * (value(full - out[:, t]) - base) for t in range(len(model))]

    def compare(self, ours: Ensemble, naive: Ensemble, metric) -> tuple[float, float, int] | None:
        """Mean and deviation of the paired differences of row losses, and their number; None if the metric has none."""
        if callable(metric) or metric == "auc":
            return None
        d = np.subtract(*(M.row_loss(metric, self.y, m.raw(self.x), m.objective, m.sigmoid) for m in (ours, naive)))
        return float(d.mean()), float(d.std(ddof=1)) if self.n > 1 else 0.0, self.n

    def removals(self, model: Ensemble, candidates: list[int], metric, min_z: float) -> Iterator[tuple[int, bool]]:
        """Whether each candidate's removal improves the metric on top of those that did before."""
        now = model.raw(self.x)
        out = model.keep(candidates).outputs(self.x)
        paired = min_z > 0 and not callable(metric) and metric != "auc"
        judge = (lambda raw: M.row_loss(metric, self.y, raw, model.objective, model.sigmoid)) if paired else (lambda raw: M.metric_of(metric, self.y, raw, model.objective, model.sigmoid))
        was = judge(now)
        for k, c in enumerate(candidates):
            trial = now - out[:, k]
            got = judge(trial)
            if paired:
                d = got - was
                better = M.passes(float(d.mean()), float(d.std(ddof=1)) if self.n > 1 else 0.0, self.n, min_z)
            else:
                better = got > was if metric == "auc" else got < was
            if better:
                now, was = trial, got
            yield c, better

    def split(self, n_hold: int) -> tuple["LocalRows", "LocalRows"]:
        """Head and tail: the last ``n_hold`` rows in time are the tail."""
        at = self.n - n_hold
        part = lambda s: LocalRows(self.features, self.x[s], self.y[s], self.w[s], self.h[s])
        return part(slice(0, at)), part(slice(at, None))

    def sample(self, most: int, seed: int) -> "LocalRows":
        """At most ``most`` rows, in their order."""
        if self.n <= most:
            return self
        keep = np.sort(np.random.default_rng(seed).choice(self.n, most, replace=False))
        return LocalRows(self.features, self.x[keep], self.y[keep], self.w[keep], self.h[keep])

    def table(self, spark: SparkSession) -> DataFrame:
        """x0, x1, ..., y, w, o, h as a DataFrame; missing values, NaN in the arrays, are null there."""
        data = pd.DataFrame(self.x, columns=[f"x{i}" for i in range(len(self.features))])
        return frame_of(spark, data.assign(y=self.y, w=self.w, o=np.arange(self.n), h=self.h))

    def with_rows(self, others: list["LocalRows"]) -> "LocalRows | TableRows":
        """The others' rows, then these."""
        if not others:
            return self
        if any(isinstance(o, TableRows) for o in others):
            spark = next(o.df.sparkSession for o in others if isinstance(o, TableRows))
            return TableRows(self.features, self.table(spark), self.n).with_rows(others)
        joined = lambda k: np.concatenate([getattr(r, k) for r in (*others, self)])
        return LocalRows(self.features, joined("x"), joined("y"), joined("w"), joined("h"))

    def train(self, base: Ensemble, rounds: int, params: BoostParams, held: "LocalRows | TableRows | None" = None, patience: int | None = None, bounds=None) -> Ensemble:
        extra = (held.x, held.y, patience) if isinstance(held, LocalRows) else (None, None, None)
        return boost(self.x, self.y, self.w, base, rounds, params, *extra, bounds=bounds)

    def renamed(self, features: list[str]) -> "LocalRows":
        return LocalRows(features, self.x, self.y, self.w, self.h)

    def bins(self, params: BoostParams) -> list[np.ndarray]:
        return _bins(self.x, params.max_bin - 1)


class TableRows:
    """A batch as a written table (x0, x1, ..., y, w, o, h) of any number of rows."""

    def __init__(self, features: list[str], df: DataFrame, n: int) -> None:
        self.features, self.df, self.n = features, df, n

    def _named(self) -> DataFrame:
        """The table under the features' names, with y, w, o and h kept apart from them."""
        return self.df.select(F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("o").alias("_o"), F.col("h").alias("_h"), *[F.col(f"x{i}").alias(f) for i, f in enumerate(self.features)])

    def label_range(self) -> tuple[float | None, float | None]:
        r = self.df.agg(F.min("y"), F.max("y")).first()
        return r[0], r[1]

    def _sampled(self, model: Ensemble) -> tuple[np.ndarray, np.ndarray]:
        """Labels and the trees' outputs of the rows that callables get."""
        share = min(1.0, CALLABLE_ROWS / max(1, self.n))
        some = self._named().where(F.pmod(F.xxhash64("_h", "_o"), F.lit(1 << 30)) < share * (1 << 30))
        got = pandas_of(with_raw(some, model, per_tree="_out").select("_y", "_out"))
        return got["_y"].to_numpy(), np.stack(got["_out"].to_numpy()) if len(got) else np.zeros((0, len(model)))

    def loss(self, model: Ensemble, metric) -> float:
        if callable(metric):
            y, out = self._sampled(model)
            return M.metric_of(metric, y, total(out), model.objective, model.sigmoid)
        v = M.evaluate(with_raw(self._named(), model, "_raw"), metric, "_y", "_raw", [], model.sigmoid, model.objective).first()["value"]
        return math.nan if v is None else 1 - v if metric == "auc" else v

    def leave_one_out(self, model: Ensemble, metric) -> tuple[float | None, list[float]]:
        if callable(metric):
            y, out = self._sampled(model)
            value = lambda raw: M.metric_of(metric, y, raw, model.objective, model.sigmoid)
            base = value(total(out))
            return base, [value(total(out) - out[:, t]) - base for t in range(len(model))]
        loss = self.loss(model, metric)
        held = with_raw(self._named(), model, per_tree="out").select(F.col("_y").alias("y"), "out")
        scores = {r["tree_id"]: r["score"] for r in loo_scores(held, metric, "y", model.sigmoid, model.objective, len(model)).collect()}
        return 1 - loss if metric == "auc" else loss, [scores[t] for t in range(len(model))]

    def compare(self, ours: Ensemble, naive: Ensemble, metric) -> tuple[float, float, int] | None:
        if callable(metric) or metric == "auc":
            return None
        both = with_raw(with_raw(self._named(), ours, "_a"), naive, "_b")
        loss = lambda c: M.row_loss(metric, F.col("_y"), F.col(c), ours.objective, ours.sigmoid)
        r = both.agg(*M.z_gate(loss("_a") - loss("_b"))).first()
        return r["mean"], r["sd"] or 0.0, r["n"]

    def removals(self, model: Ensemble, candidates: list[int], metric, min_z: float) -> Iterator[tuple[int, bool]]:
        """One aggregate a step, over a written table of the candidates' outputs."""
        if callable(metric):
            y, out = self._sampled(model)
            now = total(out)
            was = M.metric_of(metric, y, now, model.objective, model.sigmoid)
            for c in candidates:
                got = M.metric_of(metric, y, now - out[:, c], model.objective, model.sigmoid)
                if better := got < was:
                    now, was = now - out[:, c], got
                yield c, better
            return
        out = with_raw(with_raw(self._named(), model, "_raw"), model.keep(candidates), per_tree="_out")
        held = written(out.select(F.col("_y").alias("y"), F.col("_raw").alias("raw"), F.col("_out").alias("out")), "removals")
        gone: list[int] = []
        raw = lambda ids: F.col("raw") - sum((F.get("out", F.lit(k)) for k in ids), F.lit(0.0))
        loss = lambda r: M.row_loss(metric, F.col("y"), r, model.objective, model.sigmoid)
        for k, c in enumerate(candidates):
            if metric == "auc":
                was, got = (M.auc(held.select("y", raw(ids).alias("s")), "y", "s").first()["auc"] for ids in (gone, [*gone, k]))
                better = got > was
            else:
                r = held.agg(*M.z_gate(loss(raw([*gone, k])) - loss(raw(gone)))).first()
                better = M.passes(r["mean"], r["sd"], r["n"], min_z)
            if better:
                gone.append(k)
            yield c, better

    def split(self, n_hold: int) -> tuple["TableRows", "TableRows"]:
        """Head and tail: the last ``n_hold`` rows in time, ties by a hash of the row; equal rows at the cut go to the head."""
        from ..functions.ranges import running_before

        moment = self.df.schema["o"].dataType
        place = F.col("o").cast("timestamp").cast("double") if isinstance(moment, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col("o").cast("double")
        counts = running_before(self.df.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")), [], "p", "n")
        at = self.n - n_hold
        edge = counts.where((F.col("before") <= at) & (F.col("before") + F.col("n") > at)).first()
        rows = self.df.withColumn("p", place)
        if edge is None:
            return TableRows(self.features, self.df, self.n), TableRows(self.features, self.df.limit(0), 0)
        # Rows at the edge, in the order of their hashes; equal rows are told apart by nothing, and need not be.
        tied = running_before(rows.where(F.col("p") == edge["p"]).groupBy("h").agg(F.count(F.lit(1)).alias("n")), [], "h", "n")
        last = tied.where((F.col("before") < at - edge["before"]) & (F.col("before") + F.col("n") >= at - edge["before"])).first()
        cut = last["h"] if last else None
        early = (F.col("p") < edge["p"]) | ((F.col("p") == edge["p"]) & (F.col("h") <= F.lit(cut)) if cut is not None else F.lit(False))
        head = rows.where(early).drop("p")
        n = head.count()  # whole groups of equal rows stay together, so it can be more than asked by their number
        return TableRows(self.features, head, n), TableRows(self.features, rows.where(~early).drop("p"), self.n - n)

    def sample(self, most: int, seed: int) -> "TableRows | LocalRows":
        if self.n <= most:
            return self
        some = self.df.orderBy(F.xxhash64(F.lit(seed), "h", "o")).limit(most)
        return rows_of(some.select(*[F.col(f"x{i}").alias(f"x{i}") for i in range(len(self.features))], "y", "w", "o"), [f"x{i}" for i in range(len(self.features))], "y", "w", "o").renamed(self.features)

    def table(self, spark: SparkSession) -> DataFrame:
        return self.df

    def with_rows(self, others: list) -> "TableRows":
        if not others:
            return self
        spark = self.df.sparkSession
        tables = [o.table(spark).drop("o") for o in others]
        out = self.df.drop("o")
        for t in tables:
            out = out.unionByName(t)
        return TableRows(self.features, out.withColumn("o", F.lit(0)), self.n + sum(o.n for o in others))

    def renamed(self, features: list[str]) -> "TableRows":
        return TableRows(features, self.df, self.n)

    def train(self, base: Ensemble, rounds: int, params: BoostParams, held=None, patience: int | None = None, bounds=None) -> Ensemble:
        names = [f"x{i}" for i in range(len(self.features))]
        own = Ensemble(tuple(names), _renamed(base.trees, dict(zip(self.features, names))), base.objective, base.sigmoid)
        extra = held.table(self.df.sparkSession) if held is not None and patience else None
        out = boost_frame(self.df, own, rounds, params, extra, patience, bounds)
        return Ensemble(base.features, _renamed(out.trees, dict(zip(names, self.features))), base.objective, base.sigmoid)

    def bins(self, params: BoostParams) -> list[np.ndarray]:
        return frame_bins(self.df, [f"x{i}" for i in range(len(self.features))], params.max_bin - 1)


def _renamed(trees: tuple, names: dict[str, str]) -> tuple:
    return tuple(tuple(n if n[0] else (n[0], names[n[1]], *n[2:]) for n in tree) for tree in trees)
