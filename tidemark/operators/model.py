"""The incremental model: fit, guarded partial_fit with drift handling and tree retirement, predict and reports."""

from __future__ import annotations

import json
import math
import time
import uuid
import warnings
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import metrics as M
from ..functions import tables
from ..functions.prep import feature_names
from .drift import DistributionTracker, DriftReport
from .ensemble import DriftWarning, Ensemble, TreeManager, with_raw
from .importance import ClusteredImportance, METHODS
from .rows import LocalRows, TableRows, rows_of
from .trainer import BoostParams

#: One-sided 95 % bar of the paired comparison, standard errors by which a retired tree must hurt, rows that each side
#: of a hold-out needs, and the share of the trees that one update may remove.
NAIVE_Z, RETIRE_Z, LEAST_HOLDOUT, MOST_REMOVED = 1.645, 2.0, 20, 0.5
HISTORY = "batch long, stage string, action string, n_rows long, validation string, n_val_rows long, drift_detected boolean, n_drifted_features int, fraction_drifted double, drifted_features array<string>, p_value_threshold double, rebin_triggered boolean, rebin_accepted boolean, trees_before int, trees_retired int, trees_evicted int, trees_added int, trees_after int, metric string, prequential_loss double, val_loss_before double, val_loss_after double, candidate_loss_ours double, candidate_loss_naive double, window_batches_used int, train_rows_used long, notes array<string>, seconds double"
# The names and defaults of the parameters, and other names of the number of rounds.
DEFAULTS = {"task": "regression", "n_estimators_per_batch": 100, "max_total_trees": 1000, "drift_threshold": 0.01, "drift_fraction": 0.3, "retirement_threshold": 0.0, "correlation_method": "spearman", "cluster_distance_threshold": 0.5, "store_recent_data": True, "max_stored_batches": 3, "verbose": 0, "max_rows_per_stored_batch": 10_000, "validation_fraction": 0.2, "safety_checks": True, "scoring_metric": None, "objective": None, "n_bins": 256, "min_ks_statistic": 0.0, "class_weight": None, "random_state": 0, "importance_type": "split"}
ROUNDS = ("num_iteration", "num_iterations", "n_iter", "num_tree", "num_trees", "num_round", "num_rounds", "num_boost_round", "nrounds", "max_iter")

Rows = LocalRows | TableRows


@dataclass(frozen=True)
class Candidate:
    """One way to go on: which trees stay, and which stored batches are learned from besides the new rows."""

    removed: tuple[int, ...]
    base: Ensemble
    window: tuple = ()

    def train(self, rows: Rows, rounds: int, params: BoostParams) -> tuple[Ensemble, int]:
        """The trained ensemble and the number of rows it learned from."""
        data = rows.with_rows(list(self.window))
        return data.train(self.base, rounds, params), data.n


class IncrementalBooster:
    """Gradient boosting that follows batches in time order.

    Rows are DataFrames of feature columns, a label and optionally a weight and an order column. On drift the
    model proposes a rebuilt window and retired trees; a proposal is taken only if it is significantly better than
    plain continuation on rows that neither was trained on. Sample weights affect training only.
    """

    def __init__(self, **params) -> None:
        self.params, self.boost = dict(DEFAULTS), {}
        self.set_params(**params)
        self.ensemble_: Ensemble | None = None

    def get_params(self) -> dict:
        return self.params | self.boost

    def set_params(self, **params) -> "IncrementalBooster":
        for k, v in params.items():
            if k == "n_estimators":
                self.params["n_estimators_per_batch"] = v
            elif k in ROUNDS:
                raise ValueError(f"use n_estimators_per_batch instead of {k}")
            elif k in DEFAULTS:
                self.params[k] = v
            elif k in BoostParams.__dataclass_fields__:
                self.boost[k] = v
            else:
                raise ValueError(f"unknown parameter {k!r}")
        return self

    def clone(self) -> "IncrementalBooster":
        return type(self)(**self.get_params())

    def __repr__(self) -> str:
        changed = {k: v for k, v in self.params.items() if v != DEFAULTS[k]} | self.boost
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in changed.items())})"

    # Checks and small properties.

    def _validate(self) -> None:
        p = self.params
        if p["task"] not in ("regression", "classification"):
            raise ValueError(f"task {p['task']!r} is neither regression nor classification")
        if p["n_estimators_per_batch"] < 1 or p["max_total_trees"] < p["n_estimators_per_batch"]:
            raise ValueError("n_estimators_per_batch must be 1 or more and at most max_total_trees")
        if not 0 < p["drift_threshold"] < 1:
            raise ValueError("drift_threshold must lie between 0 and 1")
        for k in ("drift_fraction", "validation_fraction"):
            if not 0 <= p[k] < 1:
                raise ValueError(f"{k} must be 0 or more and below 1")
        if not 0 <= p["cluster_distance_threshold"] <= 1 or not 0 <= p["min_ks_statistic"] <= 1:
            raise ValueError("cluster_distance_threshold and min_ks_statistic must lie in [0, 1]")
        if p["store_recent_data"] and p["max_stored_batches"] < 1:
            raise ValueError("max_stored_batches must be 1 or more where recent data are stored")
        if p["correlation_method"] not in METHODS:
            raise ValueError(f"correlation_method must be one of {METHODS}")
        objective, classes = p["objective"], p["task"] == "classification"
        if callable(objective):
            raise NotImplementedError("an objective is given by name")
        if objective is not None and classes != (objective in M.PROBABILITY):
            if classes or objective in ("binary", "multiclass", "multiclassova", "lambdarank"):
                raise ValueError(f"objective {objective!r} does not match task {p['task']!r}")
        if objective not in (None, "regression", "l2", "mse", *M.PROBABILITY):
            raise NotImplementedError(f"objective {objective!r} is not trained here")
        M.resolve(p["scoring_metric"], self._objective())

    def _objective(self) -> str:
        own = self.params["objective"]
        return own if own in M.PROBABILITY else "binary" if self.params["task"] == "classification" else "regression"

    def _fitted(self) -> None:
        if self.ensemble_ is None:
            raise RuntimeError("the model is not fitted; call fit first")

    @property
    def is_fitted(self) -> bool:
        return self.ensemble_ is not None

    @property
    def n_trees_(self) -> int:
        self._fitted()
        return len(self.ensemble_)

    @property
    def n_features_(self) -> int:
        self._fitted()
        return len(self.features_)

    @property
    def drift_report_(self) -> DriftReport:
        self._fitted()
        return self.drift_reports_[-1]

    def _metric(self):
        return M.resolve(self.params["scoring_metric"], self._objective())

    def _label(self) -> str:
        m = self._metric()
        return getattr(m, "__name__", "callable") if callable(m) else m

    # Rows.

    def _rows(self, df: DataFrame, y: str, w: str | None, order: str | None) -> Rows:
        """Rows with the features, the label (0 or 1 for classes) and the training weight."""
        feature_names(df, [c for c in df.columns if c in self.features_], self.features_)
        label = F.col(f"`{y}`")
        weight: Column = F.col(f"`{w}`").cast("double") if w else F.lit(1.0)
        if self._objective() in M.PROBABILITY:
            counts = {r[0]: r[1] for r in df.groupBy(label.alias("label")).agg(F.count(F.lit(1))).limit(100).collect()}
            if self.classes_ is None:
                if len(counts) > 2:
                    raise NotImplementedError("more than two classes")
                self.classes_ = sorted(k for k in counts if k is not None)
            if extra := set(counts) - set(self.classes_):
                raise ValueError(f"labels {sorted(map(str, extra))[:5]} were not there at fit: {self.classes_}")
            coded = (label == F.lit(self.classes_[-1])).cast("double") if len(self.classes_) > 1 else F.lit(0.0)
            given = self.params["class_weight"]
            if given == "balanced":
                given = {k: sum(counts.values()) / (len(counts) * n) for k, n in counts.items()}
            for k, factor in (given or {}).items():
                weight = F.when(label == F.lit(k), weight * float(factor)).otherwise(weight)
        else:
            coded = label.cast("double")
        slim = df.select(*[F.col(f"`{f}`").alias(f"x{i}") for i, f in enumerate(self.features_)], coded.alias("_y"), weight.alias("_w"), *([F.col(f"`{order}`").alias("_o")] if order else []))
        return rows_of(slim, [f"x{i}" for i in range(len(self.features_))], "_y", "_w", "_o" if order else None).renamed(self.features_)

    def _held(self, eval_set, y: str) -> Rows | None:
        """Rows of the first evaluation set."""
        if eval_set is None:
            return None
        first = eval_set[0] if isinstance(eval_set, (list, tuple)) and eval_set else eval_set
        if not isinstance(first, DataFrame):
            raise ValueError("eval_set is a DataFrame or a list of them")
        return self._rows(first, y, None, None)

    def _watched(self, rows: Rows):
        """What the tracker reads: arrays, or the table under the features' names."""
        if isinstance(rows, LocalRows):
            return {f: rows.x[:, i] for i, f in enumerate(self.features_)}
        return rows.df.select(*[F.col(f"x{i}").alias(f) for i, f in enumerate(self.features_)])

    # Learning.

    def fit(self, df: DataFrame, y: str = "y", features: list[str] | None = None, w: str | None = None, order: str | None = None, eval_set: DataFrame | list[DataFrame] | None = None, early_stopping_rounds: int | None = None) -> "IncrementalBooster":
        """Train from scratch; the batch becomes the drift reference and snapshot 0."""
        began, p = time.time(), self.params
        self._validate()
        self.spark_ = df.sparkSession
        self.classes_ = None
        self.features_ = feature_names(df, features or [c for c in df.columns if c not in (y, w, order)])
        rows = self._rows(df, y, w, order)
        if not rows.n:
            raise ValueError("no rows to fit")
        held = self._held(eval_set, y)
        self.boost_params_ = BoostParams(**self.boost)
        base = Ensemble(tuple(self.features_), (), self._objective(), self.boost_params_.sigmoid)
        self.ensemble_ = rows.train(base, p["n_estimators_per_batch"], self.boost_params_, held, early_stopping_rounds)
        self.tracker_ = DistributionTracker(p["n_bins"], p["drift_threshold"], p["drift_fraction"], min_ks_statistic=p["min_ks_statistic"])
        self.drift_reports_ = [self.tracker_.update(self._watched(rows))]
        self.window_limit_ = p["max_stored_batches"] if p["store_recent_data"] else 0
        self.stored_: list[Rows] = []
        self.history_: list[dict] = []
        self.snapshots_ = [self.ensemble_.importance("gain")]
        self._store(rows)
        loss = held.loss(self.ensemble_, self._metric()) if held is not None else None
        self._record(stage="fit", action="initial_fit", n_rows=rows.n, validation="eval_set" if held is not None else "none", n_val_rows=held.n if held is not None else 0, trees_before=0, trees_added=len(self.ensemble_), trees_after=len(self.ensemble_), val_loss_after=loss, train_rows_used=rows.n, seconds=time.time() - began)
        return self

    def _proposals(self, rows: Rows, scored_on: Rows, rebin: bool, notes: list[str]) -> tuple[Candidate, Candidate, int, int, int, int]:
        """Ours and the plain one, the number of new trees, and how many trees ours retires and evicts; and what may still go."""
        now, p = self.ensemble_, self.params
        budget, rounds = math.floor(MOST_REMOVED * len(now)), p["n_estimators_per_batch"]
        over = max(0, len(now) + rounds - p["max_total_trees"])
        if over > budget:
            rounds, over = rounds - (over - budget), budget
            notes.append(f"max_total_trees leaves room for {rounds} new trees only")
        manager = TreeManager(now, MOST_REMOVED)
        try:
            manager.score_trees(scored_on, metric=p["scoring_metric"])
            retire = manager.select_retirement(p["retirement_threshold"], max_count=budget, min_z=RETIRE_Z)
            plain, evict = manager.lowest_scoring(over), manager.lowest_scoring(over - len(retire), retire)
        except ValueError as failed:
            notes.append(f"trees were not scored: {failed}")
            retire, plain = [], list(range(1, over + 1))  # the oldest go; tree 0 carries the base score
            evict = plain
        kept = lambda gone: now.keep([t for t in range(len(now)) if t not in set(gone)])
        window = tuple(self._compatible(rows)) if rebin else ()
        ours = Candidate(tuple(retire + evict), kept(retire + evict), window)
        return ours, Candidate(tuple(plain), kept(plain)), rounds, len(retire), len(evict), budget - len(retire) - len(evict)

    def _naive_wins(self, rows: Rows, ours: Ensemble, naive: Ensemble) -> tuple[bool, float, float]:
        """Whether the plain update is kept: unless ours is better by NAIVE_Z standard errors of the paired row losses."""
        metric = self._metric()
        a, b = rows.loss(ours, metric), rows.loss(naive, metric)
        paired = rows.compare(ours, naive, metric) if rows.n > 1 else None
        return (a > b if paired is None else not M.passes(*paired, NAIVE_Z)), a, b

    def partial_fit(self, df: DataFrame, y: str = "y", features: list[str] | None = None, w: str | None = None, order: str | None = None, eval_set: DataFrame | list[DataFrame] | None = None) -> "IncrementalBooster":
        """Learn from the next batch: drift test, retirement, window, candidates, and the guarded choice."""
        if self.ensemble_ is None:
            return self.fit(df, y, features, w, order, eval_set)
        began, p, start = time.time(), self.params, self.ensemble_
        self._validate()
        self.spark_ = df.sparkSession
        rows, held, notes = self._rows(df, y, w, order), self._held(eval_set, y), []
        if not rows.n:
            raise ValueError("no rows in the batch")
        metric = self._metric()
        report = self.tracker_.update(self._watched(rows))
        self.drift_reports_.append(report)
        rebin = report.needs_rebin
        before = rows.loss(start, metric)
        held_before = held.loss(start, metric) if held is not None else None
        ours, plain, rounds, n_retired, n_evicted, budget = self._proposals(rows, rows if held is None else held, rebin, notes)
        compare = p["safety_checks"] and (rebin or set(ours.removed) != set(plain.removed))
        n_hold = round(rows.n * p["validation_fraction"])
        if held is not None:
            mode, n_val = "eval_set", held.n
        elif compare and min(n_hold, rows.n - n_hold) >= LEAST_HOLDOUT:
            mode, n_val = "holdout", n_hold
        else:
            mode, n_val = "prequential", 0
            if compare:
                notes.append("too little data to hold out: taken without comparison with plain continuation")
        use_plain, loss_ours, loss_plain = False, None, None
        if mode == "holdout":
            head, tail = rows.split(n_hold)
            use_plain, loss_ours, loss_plain = self._naive_wins(tail, *(c.train(head, rounds, self.boost_params_)[0] for c in (ours, plain)))
        made, learned = (plain if use_plain else ours).train(rows, rounds, self.boost_params_)
        post: list[int] = []
        final = made
        if held is not None:
            if budget > 0 and len(made):
                after = TreeManager(made, 1.0)
                try:
                    after.score_trees(held, metric=p["scoring_metric"])
                    post = after.select_retirement(p["retirement_threshold"], max_count=budget, min_z=RETIRE_Z)
                    final = after.retire_trees(post)
                except ValueError as failed:
                    notes.append(f"new trees were not scored: {failed}")
            if compare:
                other, n_other = plain.train(rows, rounds, self.boost_params_)
                use_plain, loss_ours, loss_plain = self._naive_wins(held, final, other)
                if use_plain:
                    made, final, learned, post = other, other, n_other, []
        action = "rebin" if rebin else "incremental"
        if use_plain:
            action = "rebin_rejected" if rebin else "retirement_rejected"
            what = f"{'rebin' if rebin else 'retirement of trees'}: {mode} {self._label()} {loss_ours:.5g} against {loss_plain:.5g} of plain continuation, which is kept"
            notes.append(f"batch {len(self.history_)}, {what}")
            if loss_ours > loss_plain:
                warnings.warn(f"batch {len(self.history_)}, worse with {what}", DriftWarning, stacklevel=2)
        first = len((plain if use_plain else ours).base)
        fresh = [t for t in range(first, len(made)) if t not in set(post)]
        self.ensemble_ = final
        self.snapshots_.append(made.importance("gain", fresh))
        if rebin:
            self.tracker_.reset(self._watched(rows))
        self._store(rows)
        self._record(
            stage="partial_fit", action=action, n_rows=rows.n, validation=mode, n_val_rows=n_val, drift_detected=bool(report.drifted), n_drifted_features=len(report.drifted), fraction_drifted=report.fraction_drifted, drifted_features=report.drifted, p_value_threshold=report.threshold,
            rebin_triggered=rebin, rebin_accepted=action == "rebin" if rebin else None, trees_before=len(start), trees_retired=0 if use_plain else n_retired + len(post), trees_evicted=len(plain.removed) if use_plain else n_evicted, trees_added=len(fresh), trees_after=len(final),
            prequential_loss=before, val_loss_before=held_before, val_loss_after=held.loss(final, metric) if held is not None else None, candidate_loss_ours=loss_ours, candidate_loss_naive=loss_plain,
            window_batches_used=0 if use_plain else len(ours.window), train_rows_used=learned, notes=notes, seconds=time.time() - began)
        return self

    def _compatible(self, rows: Rows) -> list[Rows]:
        """Stored batches from which the new one has not drifted."""
        p = self.params
        probe = lambda: DistributionTracker(p["n_bins"], p["drift_threshold"], p["drift_fraction"], min_ks_statistic=p["min_ks_statistic"])
        return [s for s in self.stored_ if not probe().fit(self._watched(s)).update(self._watched(rows)).needs_rebin]

    def _store(self, rows: Rows) -> None:
        """Keep at most max_rows_per_stored_batch of the rows, of the last batches only."""
        if self.window_limit_:
            self.stored_ = [*self.stored_, rows.sample(self.params["max_rows_per_stored_batch"], self.params["random_state"] + len(self.history_))][-self.window_limit_ :]

    def _record(self, **row) -> None:
        keys = [c.split()[0] for c in HISTORY.split(", ")]
        base = {"batch": len(self.history_), "drift_detected": False, "n_drifted_features": 0, "fraction_drifted": 0.0, "drifted_features": [], "p_value_threshold": self.params["drift_threshold"], "rebin_triggered": False, "rebin_accepted": None, "trees_retired": 0, "trees_evicted": 0, "window_batches_used": 0, "notes": [], "metric": self._label()}
        self.history_.append({k: (base | row).get(k) for k in keys})
        if self.params["verbose"]:
            print(f"[tidemark] {self._describe(self.history_[-1])}")

    @staticmethod
    def _describe(r: dict) -> str:
        if r["stage"] == "fit":
            return f"fit: {r['trees_after']} trees on {r['n_rows']} rows"
        loss = "" if r["prequential_loss"] is None else f", {r['metric']} before it {r['prequential_loss']:.5g}"
        return f"batch {r['batch']}: {r['action']}, {r['n_drifted_features']} features drifted, {r['trees_retired']} trees retired, {r['trees_evicted']} evicted, {r['trees_added']} added, {r['trees_after']} now{loss}"

    def history(self, spark: SparkSession) -> DataFrame:
        keys = [c.split()[0] for c in HISTORY.split(", ")]
        plain = lambda v: v.item() if hasattr(v, "item") else v
        return spark.createDataFrame([tuple(plain(h[k]) for k in keys) for h in self.history_], HISTORY)

    # Use.

    def predict_raw(self, df: DataFrame, out: str = "raw") -> DataFrame:
        self._fitted()
        return with_raw(df, self.ensemble_, out)

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """The probability of the second class."""
        if self.params["task"] != "classification":
            raise AttributeError("predict_proba is for classification")
        return self.predict_raw(df, "_raw").withColumn(out, M.transform(self._objective(), F.col("_raw"), self.ensemble_.sigmoid)).drop("_raw")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.params["task"] == "classification":
            c = self.classes_ if self.ensemble_ else [None]
            return self.predict_proba(df, "_p").withColumn(out, F.when(F.col("_p") > 0.5, F.lit(c[-1])).otherwise(F.lit(c[0]))).drop("_p")
        return self.predict_raw(df, "_raw").withColumn(out, M.transform(self._objective(), F.col("_raw"))).drop("_raw")

    def score(self, df: DataFrame, y: str = "y", w: str | None = None) -> float:
        """Weighted R squared, or accuracy."""
        p, weight = self.predict(df, "_pred"), F.col(f"`{w}`").cast("double") if w else F.lit(1.0)
        label = F.col(f"`{y}`")
        if self.params["task"] == "classification":
            return p.agg(F.sum(weight * (label == F.col("_pred")).cast("double")) / F.sum(weight)).first()[0]
        return p.agg(M.r2(label, F.col("_pred"), weight)).first()[0]

    def feature_importances(self, kind: str | None = None) -> dict[str, float]:
        self._fitted()
        return self.ensemble_.importance(kind or self.params["importance_type"])

    def feature_importance_report(self, df: DataFrame, y: str | None = None):
        """The clustered report of the ensemble, with the stability over the snapshots of all updates."""
        self._fitted()
        method, threshold = self.params["correlation_method"], self.params["cluster_distance_threshold"]
        engines = self.__dict__.setdefault("_engines", {})
        engine = engines.setdefault((method, threshold), ClusteredImportance(method, threshold, random_state=self.params["random_state"]))
        if y is not None and self.params["task"] == "classification":
            df = df.withColumn(y, (F.col(f"`{y}`") == F.lit(self.classes_[-1])).cast("double"))
        return engine.compute(self.ensemble_, df, y, self.snapshots_)

    # Keeping.

    def save(self, spark: SparkSession, path: str) -> None:
        """The state as JSON, the nodes and the stored batches as Parquet; complete, or not there.

        A callable metric is not kept. An older state under ``path`` is replaced.
        """
        self._fitted()
        if callable(self.params["scoring_metric"]):
            warnings.warn("a callable metric is not saved; set it again after loading", DriftWarning, stacklevel=2)
        params = {k: None if callable(v) else sorted(v.items(), key=str) if isinstance(v, dict) else v for k, v in self.params.items()}
        state = {k: getattr(self, k) for k in ("boost", "features_", "classes_", "snapshots_", "history_", "window_limit_")}
        state |= {"params": params, "boost_params": asdict(self.boost_params_), "tracker": self.tracker_.state(), "objective": self.ensemble_.objective, "sigmoid": self.ensemble_.sigmoid, "trees": len(self.ensemble_), "stored": len(self.stored_), "report": asdict(self.drift_report_)}
        fresh = f"{path}.{uuid.uuid4().hex}"
        self.ensemble_.to_frame(spark).coalesce(1).write.parquet(f"{fresh}/nodes")
        for i, rows in enumerate(self.stored_):
            rows.table(spark).write.parquet(f"{fresh}/stored/{i}")
        plain = lambda v: v.item()
        spark.createDataFrame([(json.dumps(state, default=plain),)], "value string").coalesce(1).write.text(f"{fresh}/state")
        tables.delete(spark, path)
        if not tables.rename(spark, fresh, path):
            raise RuntimeError(f"{path} was written by another at the same time")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IncrementalBooster":
        s = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()["value"])
        weights = s["params"]["class_weight"]
        out = cls(**(s["params"] | {"class_weight": dict(map(tuple, weights)) if isinstance(weights, list) else weights}), **s["boost"])
        for k in ("features_", "classes_", "snapshots_", "history_", "window_limit_"):
            setattr(out, k, s[k])
        out.spark_, out.boost_params_, out.tracker_ = spark, BoostParams(**s["boost_params"]), DistributionTracker.from_state(s["tracker"])
        out.drift_reports_ = [DriftReport(**s["report"])]
        out.tracker_.last_report = out.drift_reports_[-1]
        names = list(out.features_)
        out.ensemble_ = Ensemble.from_frame(spark.read.parquet(f"{path}/nodes"), names, s["objective"], s["sigmoid"])
        inner = [f"x{i}" for i in range(len(names))]
        out.stored_ = [rows_of(spark.read.parquet(f"{path}/stored/{i}"), inner, "y", "w", "o").renamed(names) for i in range(s["stored"])]
        return out
