"""Distribution drift per feature: quantile digests, grid Kolmogorov-Smirnov tests and running histograms.

Every batch is one pass: values are bucketed against the reference edges inside the JVM and summed up with map-side
combine, so what reaches the driver is (features x edges) numbers at any size of the batch. A reference is selected
from by narrowing brackets, a pass or two each round; its values are never sorted nor shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.prep import clean, feature_names, finite
from ..functions.tables import pandas_of

#: Rows of (feature, value, count) that are brought to the driver at most, and levels of the sketch of a bracket.
COLLECTED, GRID = 1 << 21, 256
_INF = float("inf")


def bucketed(df: DataFrame, edges: dict[str, list[float]], flag: Callable[[str, Column, Column], Column]) -> DataFrame:
    """(feature, bucket, value, flag) for every value that is present: bucket is the number of edges up to it.

    flag: what the last column is, from the feature, its bucket and its value.
    """
    features = list(edges)
    wide = clean(df, features).toDF(*[f"x{i}" for i in range(len(features))])
    # A feature without edges still needs one for the bucketing.
    cut = Bucketizer(splitsArray=[[-_INF, *(edges[f] or [0.0]), _INF] for f in features], inputCols=wide.columns, outputCols=[f"b{i}" for i in range(len(features))], handleInvalid="keep").transform(wide)
    cells = []
    for i, f in enumerate(features):
        bucket, value = F.col(f"b{i}").cast("int") if edges[f] else F.lit(0), F.col(f"x{i}")
        cells.append(F.struct(F.lit(f).alias("feature"), bucket.alias("bucket"), value.alias("value"), flag(f, bucket, value).alias("flag")))
    return cut.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("value IS NOT NULL")


def value_counts(df: DataFrame, features: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct values and their rows of each feature; for tables of at most COLLECTED cells."""
    wide = clean(df, features).toDF(*[f"x{i}" for i in range(len(features))])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"x{i}").alias("value")) for i in range(len(features))])).alias("c")
    found = pandas_of(wide.select(cells).select("c.*").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows")))
    out = {}
    for i, f in enumerate(features):
        mine = found[found["feature"] == i].sort_values("value")
        out[f] = (mine["value"].to_numpy("float64"), mine["rows"].to_numpy("int64"))
    return out


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], limit: int = COLLECTED) -> dict[str, dict[int, float]]:
    """The values at the given ranks (from 0) among each feature's present values.

    A rank lies in a bracket of values whose first rank is known. Each round sketches the quantiles inside the
    brackets, narrows every bracket to the few sketch levels around its rank, and counts exactly how many values lie
    below, on its ends and inside; a rank that falls on an end is found. So a round leaves some GRID / 4 times fewer
    rows, and when ``limit`` are left they are brought to the driver. Ends that hold many equal values drop out, so
    ties don't hold up the narrowing.
    """
    found: dict[str, dict[int, float]] = {f: {} for f in ranks}
    # (feature, least value, greatest value) -> (values below, values inside, ranks)
    open_: dict[tuple[str, float, float], tuple[int, int, list[int]]] = {(f, -_INF, _INF): (0, limit + 1, sorted(set(r))) for f, r in ranks.items() if r}
    while open_:
        names = sorted({f for f, _, _ in open_})
        edges = {f: sorted({e for g, lo, hi in open_ if g == f for e in (lo, math.nextafter(hi, _INF)) if abs(e) != _INF}) for f in names}
        place = {(f, 0 if lo == -_INF else edges[f].index(lo) + 1): (f, lo, hi) for f, lo, hi in open_}
        rows = bucketed(df, edges, lambda f, bucket, value: bucket.isin(*[b for g, b in place if g == f])).where("flag")
        if sum(n for _, n, _ in open_.values()) <= limit:
            counted = pandas_of(rows.groupBy("feature", "bucket", "value").agg(F.count(F.lit(1)).alias("rows")))
            for (f, b), mine in counted.groupby(["feature", "bucket"]):
                mine = mine.sort_values("value")
                below, _, wanted = open_[place[f, b]]
                values = mine["value"].to_numpy()
                for r, at in zip(wanted, np.searchsorted(below + np.cumsum(mine["rows"].to_numpy()), wanted, side="right")):
                    found[f][r] = float(values[at])
            return found
        levels = [i / GRID for i in range(GRID + 1)]
        sketches = rows.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", levels, 16 * GRID).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        ends: dict[str, set[float]] = {f: set() for f in names}
        narrowed: list[tuple[str, float, float, int]] = []
        for s in sketches:
            below, _, wanted = open_[place[s["feature"], s["bucket"]]]
            for r in wanted:
                at = int((r - below) * GRID / s["n"])
                lo = s["lo"] if at < 2 else s["q"][at - 1]
                hi = s["hi"] if at > GRID - 3 else s["q"][at + 2]
                narrowed.append((s["feature"], lo, hi, r))
                ends[s["feature"]] |= {lo, hi}
        cuts = {f: sorted({c for e in ends[f] for c in (e, math.nextafter(e, _INF))}) for f in names}
        upto: dict[str, np.ndarray] = {f: np.zeros(len(cuts[f]) + 1, np.int64) for f in names}
        for r in bucketed(df, cuts, lambda f, bucket, value: F.lit(True)).groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
            upto[r["feature"]][r["bucket"]] = r["n"]
        below_cut = {f: dict(zip(cuts[f], np.cumsum(upto[f])[:-1].tolist())) for f in names}  # values below each cut
        before, open_ = open_, {}
        for f, lo, hi, r in narrowed:
            known = below_cut[f]
            past_lo, past_hi = math.nextafter(lo, _INF), math.nextafter(hi, _INF)
            if known[lo] <= r < known[past_lo]:
                found[f][r] = lo
            elif known[hi] <= r < known[past_hi]:
                found[f][r] = hi
            else:
                if r < known[lo]:  # the sketch was off by more than a level: the rank lies beyond an end
                    key = next(k for k, v in before.items() if k[0] == f and r in v[2])
                    lo, hi, start, stop = key[1], math.nextafter(lo, -_INF), before[key][0], known[lo]
                elif r >= known[past_hi]:
                    key = next(k for k, v in before.items() if k[0] == f and r in v[2])
                    lo, hi, start, stop = past_hi, key[2], known[past_hi], before[key][0] + before[key][1]
                else:
                    lo, hi, start, stop = past_lo, math.nextafter(hi, -_INF), known[past_lo], known[hi]
                _, _, wanted = open_.get((f, lo, hi), (0, 0, []))
                open_[f, lo, hi] = (start, stop - start, [*wanted, r])
        open_ = _disjoint(open_)
    return found


def _disjoint(brackets: dict) -> dict:
    """Brackets of a feature that overlap, as one."""
    out: dict = {}
    last = None
    for key in sorted(brackets):
        f, lo, hi = key
        below, n, ranks = brackets[key]
        if last and last[0] == f and lo <= last[2]:
            b, m, r = out.pop(last)
            last = (f, last[1], max(hi, last[2]))
            out[last] = (b, max(b + m, below + n) - b, sorted({*r, *ranks}))
        else:
            last = key
            out[key] = (below, n, sorted(set(ranks)))
    return out


def quantiles(df: DataFrame, features: list[str], counts: dict[str, int], n_bins: int, limit: int = COLLECTED) -> dict[str, list[float]]:
    """Exact quantiles at k / n_bins of each feature, by linear interpolation between order statistics.

    counts: the number of present values of each feature; a feature without any has no quantiles.
    """
    levels = {f: [k / n_bins * (n - 1) for k in range(n_bins + 1)] for f, n in counts.items() if n}
    ranks = {f: [r for p in ps for r in (int(p), min(int(p) + 1, counts[f] - 1))] for f, ps in levels.items()}
    at = order_statistics(df, ranks, limit)
    return {f: [at[f][int(p)] + (p - int(p)) * (at[f][min(int(p) + 1, counts[f] - 1)] - at[f][int(p)]) for p in levels[f]] if f in levels else [] for f in features}


def kolmogorov(x: float) -> float:
    """Survival function of the Kolmogorov distribution."""
    if not x > 0.1:
        return 1.0
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_p_value(ks: float, reference: int, batch: int) -> float:
    n = max(1.0, reference * batch / (reference + batch)) if reference + batch else 1.0
    root = math.sqrt(n)
    return kolmogorov((root + 0.12 + 0.11 / root) * ks)


def moments(df: DataFrame, features: list[str]) -> dict[str, dict]:
    """rows, count, missing, min, max, mean and population std of each feature, in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(features):
        x = finite(F.col(f"`{f}`"))
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return {f: {"rows": r["rows"], "count": r[f"n{i}"], "missing": r["rows"] - r[f"n{i}"], "min": r[f"lo{i}"], "max": r[f"hi{i}"], "mean": r[f"m{i}"], "std": 0.0 if r[f"lo{i}"] == r[f"hi{i}"] else r[f"s{i}"]} for i, f in enumerate(features)}


def compared(df: DataFrame, edges: dict[str, list[float]]) -> dict[str, tuple[dict, np.ndarray, np.ndarray]]:
    """For each feature its moments, the values below each edge and those up to it, in one pass over ``df``.

    Values are summed up by the number of edges up to them and by whether they are an edge: at most 2 (edges + 1)
    rows a feature, whose moments are put together on the driver.
    """
    features = list(edges)
    # The flag: whether the value is an edge.
    rows = bucketed(df, edges, lambda f, bucket, value: (bucket > 0) & (F.element_at(F.array(*[F.lit(float(e)) for e in edges[f] or [0.0]]), F.greatest(bucket, F.lit(1))) == value))
    sums: list[Column] = [F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")]
    parts = rows.groupBy("feature", "bucket", "flag").agg(*sums)
    total = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("bucket"), F.lit(False).alias("flag"), "n", *[F.lit(None).cast("double").alias(k) for k in ("lo", "hi", "mean", "var")])
    got: dict[str | None, list] = {}
    for r in parts.unionByName(total).collect():
        got.setdefault(r["feature"], []).append(r)
    size = got[None][0]["n"]
    out = {}
    for f in features:
        mine = got.get(f, [])
        below, upto = np.zeros(len(edges[f]) + 1, np.int64), np.zeros(len(edges[f]) + 1, np.int64)
        for r in mine:
            below[min(r["bucket"], len(edges[f]))] += r["n"]
            upto[min(r["bucket"] - r["flag"], len(edges[f]))] += r["n"]
        n = sum(r["n"] for r in mine)
        mean = math.fsum(r["n"] * r["mean"] for r in mine) / n if n else None
        lo, hi = min((r["lo"] for r in mine), default=None), max((r["hi"] for r in mine), default=None)
        var = math.fsum(r["n"] * (r["var"] + (r["mean"] - mean) ** 2) for r in mine) / n if n else None
        std = None if not n else 0.0 if lo == hi else math.sqrt(var)
        out[f] = ({"rows": size, "count": n, "missing": size - n, "min": lo, "max": hi, "mean": mean, "std": std}, np.cumsum(below)[: len(edges[f])], np.cumsum(upto)[: len(edges[f])])
    return out


def histogram(below: np.ndarray, upto: np.ndarray, count: int) -> tuple[list[int], int, int]:
    """Bins between edges, the last one closed; (counts, below the first edge, above the last)."""
    if not len(below):
        return [], 0, 0
    if len(below) == 1:
        return [int(upto[0] - below[0])], int(below[0]), int(count - upto[0])
    top = np.append(below[1:-1], upto[-1])
    return [int(x) for x in top - below[:-1]], int(below[0]), int(count - upto[-1])


def _moments_of(size: int, values: np.ndarray, rows: np.ndarray) -> dict:
    """The same as ``moments`` from the counts of distinct values."""
    n = int(rows.sum())
    if not n:
        return {"rows": size, "count": 0, "missing": size, "min": None, "max": None, "mean": None, "std": None}
    mean = float(values @ rows / n)
    std = float(np.sqrt((values - mean) ** 2 @ rows / n)) if len(values) > 1 else 0.0
    return {"rows": size, "count": n, "missing": size - n, "min": float(values[0]), "max": float(values[-1]), "mean": mean, "std": std}


def _present(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x)]


def _compared_array(x: np.ndarray, edges: list[float]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The same as ``compared`` of one feature's values."""
    v = np.sort(_present(x))
    return _moments_of(len(x), *np.unique(v, return_counts=True)), np.searchsorted(v, edges, side="left"), np.searchsorted(v, edges, side="right")


def _quantiles_of(values: np.ndarray, rows: np.ndarray, n_bins: int) -> list[float]:
    """The same as ``quantiles`` from the counts of distinct values."""
    n = int(rows.sum())
    if not n:
        return []
    pos = np.arange(n_bins + 1) / n_bins * (n - 1)
    lo = pos.astype(np.int64)
    low, high = (values[np.searchsorted(np.cumsum(rows), r, side="right")] for r in (lo, np.minimum(lo + 1, n - 1)))
    return [float(x) for x in low + (pos - lo) * (high - low)]


COLUMNS = "feature string, ks_statistic double, p_value double, mean_shift double, std_ratio double, out_of_range_fraction double, drifted boolean"


@dataclass
class DriftReport:
    """Per-feature results of one batch against the reference."""

    n_rows: int
    threshold: float
    drift_fraction: float
    is_reference: bool
    rows: list[dict] = field(default_factory=list)

    @property
    def drifted(self) -> list[str]:
        order = sorted(range(len(self.rows)), key=lambda i: -self.rows[i]["ks_statistic"])
        return [self.rows[i]["feature"] for i in order if self.rows[i]["drifted"]]

    @property
    def fraction_drifted(self) -> float:
        return len(self.drifted) / len(self.rows) if self.rows else 0.0

    @property
    def needs_rebin(self) -> bool:
        return not self.is_reference and self.fraction_drifted > self.drift_fraction

    def to_frame(self, spark: SparkSession) -> DataFrame:
        keys = [c.split()[0] for c in COLUMNS.split(", ")]
        return spark.createDataFrame([tuple(r[k] for k in keys) for r in self.rows], COLUMNS).orderBy(F.desc("ks_statistic"))

    def to_string(self, most: int = 20) -> str:
        names = self.drifted
        lines = [f"{len(names)} of {len(self.rows)} features drifted (p < {self.threshold:g}, {self.n_rows} rows)" + ("; rebin" if self.needs_rebin else "")]
        by = {r["feature"]: r for r in self.rows}
        lines += [f"  {n}: ks {by[n]['ks_statistic']:.4f}, p {by[n]['p_value']:.3g}, mean {by[n]['mean_shift']:+.2f} sd" for n in names[:most]]
        return "\n".join(lines + ([f"  +{len(names) - most} more"] if len(names) > most else []))

    __str__ = to_string

    def summary(self) -> None:
        print(self.to_string())


class DistributionTracker:
    """Compares batches with a reference distribution and accumulates running histograms.

    State is small (per feature ``n_bins`` numbers) and lives on the driver; ``save`` and ``load`` keep it as JSON.
    """

    def __init__(self, n_bins: int = 256, drift_threshold: float = 0.01, drift_fraction: float = 0.3, small_batch_size: int = 500, max_small_batch_threshold: float = 0.1, min_ks_statistic: float = 0.0) -> None:
        if n_bins < 2:
            raise ValueError("n_bins must be 2 or more")
        for name, value in (("drift_threshold", drift_threshold), ("max_small_batch_threshold", max_small_batch_threshold)):
            if not 0 < value < 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if not 0 <= drift_fraction <= 1 or not 0 <= min_ks_statistic <= 1 or small_batch_size < 0:
            raise ValueError("drift_fraction and min_ks_statistic must lie in [0, 1], small_batch_size at 0 or above")
        self.params = {"n_bins": n_bins, "drift_threshold": drift_threshold, "drift_fraction": drift_fraction, "small_batch_size": small_batch_size, "max_small_batch_threshold": max_small_batch_threshold, "min_ks_statistic": min_ks_statistic}
        self.features: list[str] | None = None
        self.reference: dict[str, dict] = {}
        self.running: dict[str, dict] = {}
        self.n_batches_seen = 0
        self.last_report: DriftReport | None = None

    @property
    def is_fitted(self) -> bool:
        return self.features is not None

    @property
    def n_features(self) -> int:
        return len(self._known())

    def _known(self) -> list[str]:
        if self.features is None:
            raise RuntimeError("the tracker has no reference yet; call fit or update first")
        return self.features

    def _entry(self, table: dict[str, dict], feature: str) -> dict:
        self._known()
        if feature not in table:
            raise KeyError(feature)
        return table[feature]

    def effective_threshold(self, n: int) -> float:
        p, small = self.params["drift_threshold"], self.params["small_batch_size"]
        return max(p, min(p * small / n, self.params["max_small_batch_threshold"])) if 0 < n < small else p

    def fit(self, df: DataFrame, features: list[str] | None = None) -> "DistributionTracker":
        """Make ``df`` the reference; does not count as a batch and leaves the last report.

        ``df`` is a DataFrame, or arrays by feature (missing values as NaN).
        """
        arrays = isinstance(df, dict)
        names = list(df) if arrays else feature_names(df, features, self.features)
        size = len(next(iter(df.values()), ())) if arrays else df.count()
        if not size:
            raise ValueError("the reference has no rows")
        if arrays or size * len(names) <= COLLECTED:
            counted = {f: np.unique(_present(df[f]), return_counts=True) for f in names} if arrays else value_counts(df, names)
            stats = {f: _moments_of(size, *counted[f]) for f in names}
            digest = {f: _quantiles_of(*counted[f], self.params["n_bins"]) for f in names}
            edges = {f: sorted(set(digest[f])) for f in names}
            sides = {f: [np.concatenate([[0], np.cumsum(counted[f][1])])[np.searchsorted(counted[f][0], edges[f], side=s)] for s in ("left", "right")] for f in names}
        else:
            stats = moments(df, names)
            digest = quantiles(df, names, {f: stats[f]["count"] for f in names}, self.params["n_bins"])
            edges = {f: sorted(set(digest[f])) for f in names}
            sides = {f: x[1:] for f, x in compared(df, edges).items()}
        self.features, self.reference, self.running = names, {}, {}
        for f in names:
            below, upto = sides[f]
            s = stats[f]
            hist, under, over = histogram(below, upto, s["count"])
            self.reference[f] = s | {"quantiles": digest[f], "edges": edges[f], "below": [int(x) for x in below], "upto": [int(x) for x in upto], "histogram": hist}
            self.running[f] = {k: s[k] for k in ("count", "missing", "min", "max")} | {"histogram": list(hist), "under": under, "over": over}
        return self

    reset = fit

    def update(self, df: DataFrame, features: list[str] | None = None) -> DriftReport:
        """Compare a batch with the reference and add it to the running histograms; the first batch is the reference."""
        p = self.params
        if self.features is None:
            self.fit(df, features)
            n = self.reference[self.features[0]]["rows"]
            rows = [{"feature": f, "ks_statistic": 0.0, "p_value": 1.0, "mean_shift": 0.0, "std_ratio": 1.0, "out_of_range_fraction": 0.0, "drifted": False} for f in self.features]
            report = DriftReport(n, self.effective_threshold(n), p["drift_fraction"], True, rows)
        else:
            if isinstance(df, dict):
                names = self.features
                found = {f: _compared_array(df[f], self.reference[f]["edges"]) for f in names}
            else:
                names = feature_names(df, features or [c for c in df.columns if c in self.features], self.features)
                found = compared(df, {f: self.reference[f]["edges"] for f in names})
            n = found[names[0]][0]["rows"]
            threshold = self.effective_threshold(n)
            report = DriftReport(n, threshold, p["drift_fraction"], False, [self._compare(f, *found[f], threshold) for f in names])
        self.n_batches_seen += 1
        self.last_report = report
        return report

    def _compare(self, f: str, s: dict, below: np.ndarray, upto: np.ndarray, threshold: float) -> dict:
        ref, run = self.reference[f], self.running[f]
        m, mr = s["count"], ref["count"]
        run["count"] += m
        run["missing"] += s["missing"]
        row = {"feature": f, "ks_statistic": 0.0, "p_value": 1.0, "mean_shift": 0.0, "std_ratio": 1.0, "out_of_range_fraction": 0.0, "drifted": False}
        if not m or not mr:
            return row
        ks = float(max(np.abs(below / m - np.array(ref["below"]) / mr).max(), np.abs(upto / m - np.array(ref["upto"]) / mr).max()))
        hist, under, over = histogram(below, upto, m)
        run["histogram"] = [a + b for a, b in zip(run["histogram"], hist)]
        run["under"], run["over"] = run["under"] + under, run["over"] + over
        run["min"], run["max"] = min(run["min"], s["min"]), max(run["max"], s["max"])
        sd, gap = ref["std"], s["mean"] - ref["mean"]
        row["mean_shift"] = gap / sd if sd > 0 else 0.0 if gap == 0 else math.copysign(math.inf, gap)
        row["std_ratio"] = s["std"] / sd if sd > 0 else 1.0 if s["std"] == 0 else math.inf
        row["out_of_range_fraction"] = (under + over) / m
        row["ks_statistic"], row["p_value"] = ks, ks_p_value(ks, mr, m)
        row["drifted"] = row["p_value"] < threshold and ks >= self.params["min_ks_statistic"]
        return row

    def should_rebin(self, report: DriftReport | None = None) -> bool:
        report = report or self.last_report
        return bool(report and report.needs_rebin)

    def feature_stats(self, feature: str) -> dict:
        ref, run = self._entry(self.reference, feature), self.running[feature]
        return {k: ref[k] for k in ("count", "missing", "min", "max", "mean", "std")} | {f"running_{k}": run[k] for k in ("count", "missing", "min", "max", "under", "over")} | {"out_of_range_fraction": (run["under"] + run["over"]) / run["count"] if run["count"] else 0.0}

    def reference_quantiles(self, feature: str, levels: list[float]) -> list[float]:
        q = self._entry(self.reference, feature)["quantiles"]
        return [float(x) for x in np.interp(levels, np.linspace(0, 1, len(q)), q)] if q else [math.nan] * len(levels)

    def reference_histogram(self, feature: str) -> tuple[list[float], list[int]]:
        r = self._entry(self.reference, feature)
        return r["edges"], r["histogram"]

    def running_histogram(self, feature: str) -> tuple[list[float], list[int]]:
        return self._entry(self.reference, feature)["edges"], self._entry(self.running, feature)["histogram"]

    def state(self) -> dict:
        return {"params": self.params, "features": self.features, "reference": self.reference, "running": self.running, "n_batches_seen": self.n_batches_seen, "last_report": asdict(self.last_report) if self.last_report else None}

    @classmethod
    def from_state(cls, state: dict) -> "DistributionTracker":
        out = cls(**state["params"])
        out.features, out.reference, out.running, out.n_batches_seen = state["features"], state["reference"], state["running"], state["n_batches_seen"]
        out.last_report = DriftReport(**state["last_report"]) if state.get("last_report") else None
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.state(), default=lambda v: v.item()),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DistributionTracker":
        return cls.from_state(json.loads(spark.read.text(path, wholetext=True).first()["value"]))
