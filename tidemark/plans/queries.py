"""The registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import metrics as M
from ..functions.prep import clean, finite, melt, subsample
from ..operators import drift as D, ensemble as E, importance as I
from ..operators.model import IncrementalBooster
from ..operators.rows import rows_of

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BINS = 16
CUT = "1998-01-01"
REF, BATCH = f"l_shipdate < TIMESTAMP_NTZ '{CUT}'", f"l_shipdate >= TIMESTAMP_NTZ '{CUT}'"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", *FEATURES)
    return rows.where(REF), rows.where(BATCH)


def tracked(spark: SparkSession, sf_dir: str, **options) -> tuple[D.DistributionTracker, D.DriftReport]:
    ref, batch = split(spark, sf_dir)
    tracker = D.DistributionTracker(n_bins=BINS, **options)
    tracker.update(ref, FEATURES)
    return tracker, tracker.update(batch, FEATURES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _long(condition: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM lineitem WHERE {condition.replace('TIMESTAMP_NTZ', 'TIMESTAMP')}" for f in FEATURES)


_DIGEST = f"""
    rv AS ({_long(REF)}), bv AS ({_long(BATCH)}),
    r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM rv),
    lv AS (SELECT DISTINCT feature, n, k, CAST(k AS DOUBLE) / {BINS}.0 * (n - 1) AS pos FROM r, range({BINS + 1}) t(k)),
    qt AS (SELECT lv.feature, CAST(k AS INTEGER) AS k, lo.value + (pos - floor(pos)) * (hi.value - lo.value) AS q
           FROM lv JOIN r lo ON lo.feature = lv.feature AND lo.i = CAST(floor(pos) AS BIGINT)
                   JOIN r hi ON hi.feature = lv.feature AND hi.i = least(CAST(floor(pos) AS BIGINT) + 1, lv.n - 1)),
    ed AS (SELECT feature, q AS edge, row_number() OVER (PARTITION BY feature ORDER BY q) AS k, count(*) OVER (PARTITION BY feature) AS ne FROM (SELECT DISTINCT feature, q FROM qt)),
    rc AS (SELECT ed.feature, k, ne, edge, count(*) FILTER (value < edge) AS below, count(*) FILTER (value <= edge) AS upto, count(*) AS n FROM ed JOIN rv USING (feature) GROUP BY ALL),
    bc AS (SELECT ed.feature, k, ne, edge, count(*) FILTER (value < edge) AS below, count(*) FILTER (value <= edge) AS upto, count(*) AS n FROM ed JOIN bv USING (feature) GROUP BY ALL),
    ks AS (SELECT rc.feature, max(greatest(abs(rc.below / rc.n - bc.below / bc.n), abs(rc.upto / rc.n - bc.upto / bc.n))) AS ks, max(rc.n) AS nr, max(bc.n) AS nb FROM rc JOIN bc USING (feature, k) GROUP BY 1),
    kx AS (SELECT *, (sqrt(nr * nb / (nr + nb)) + 0.12 + 0.11 / sqrt(nr * nb / (nr + nb))) * ks AS x FROM ks),
    kp AS (SELECT *, CASE WHEN x <= 0.1 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * x * x))))) END AS p FROM kx),
    mo AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, count(*) AS n FROM rv GROUP BY 1),
    mb AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, count(*) AS n FROM bv GROUP BY 1),
    oor AS (SELECT feature, max(CASE WHEN k = 1 THEN below END) AS under, max(CASE WHEN k = ne THEN n - upto END) AS over FROM bc GROUP BY 1)"""


def _hist(counts: str) -> str:
    return f"SELECT feature, CAST(k AS INTEGER) AS bin, CAST((CASE WHEN k + 1 = ne THEN lead(upto) OVER w ELSE lead(below) OVER w END) - below AS BIGINT) AS rows FROM {counts} WINDOW w AS (PARTITION BY feature ORDER BY k) QUALIFY k < ne"


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS rows, count(CASE WHEN isfinite({f}) THEN {f} END) AS present, count(*) - count(CASE WHEN isfinite({f}) THEN {f} END) AS missing FROM lineitem" for f in FEATURES))
def finite_mask_counts(spark, sf_dir):
    long = melt(table(spark, sf_dir, "lineitem"), FEATURES)
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("present"), F.sum(F.col("value").isNull().cast("long")).alias("missing"))


@query(f"WITH {_DIGEST} SELECT feature, n AS count, round(lo, 6) AS min, round(hi, 6) AS max, round(m, 6) AS mean, round(s, 6) AS std FROM mo")
def ref_moments(spark, sf_dir):
    s = D.moments(split(spark, sf_dir)[0], FEATURES)
    return rounded(spark.createDataFrame([(f, v["count"], v["min"], v["max"], v["mean"], v["std"]) for f, v in s.items()], "feature string, count long, min double, max double, mean double, std double"))


def _digest(spark, sf_dir) -> DataFrame:
    """The digest of the reference by narrowing brackets, whatever its size."""
    ref = split(spark, sf_dir)[0]
    q = D.quantiles(ref, FEATURES, {f: s["count"] for f, s in D.moments(ref, FEATURES).items()}, BINS, limit=20_000)
    return spark.createDataFrame([(f, k, x) for f in FEATURES for k, x in enumerate(q[f])], "feature string, k int, q double")


@query(f"WITH {_DIGEST} SELECT feature, k, round(q, 6) AS q FROM qt")
def ref_quantiles(spark, sf_dir):
    return rounded(_digest(spark, sf_dir))


@query(f"WITH {_DIGEST} SELECT feature, count(*) AS edges, round(min(edge), 6) AS first, round(max(edge), 6) AS last FROM ed GROUP BY 1")
def ref_edges(spark, sf_dir):
    return rounded(_digest(spark, sf_dir).groupBy("feature").agg(F.countDistinct("q").alias("edges"), F.min("q").alias("first"), F.max("q").alias("last")))


def _bins(spark, pairs) -> DataFrame:
    return spark.createDataFrame([(f, i + 1, int(n)) for f, h in pairs for i, n in enumerate(h)], "feature string, bin int, rows long")


@query(f"WITH {_DIGEST} {_hist('rc')}")
def ref_histogram(spark, sf_dir):
    t = D.DistributionTracker(n_bins=BINS).fit(split(spark, sf_dir)[0], FEATURES)
    return _bins(spark, [(f, t.reference_histogram(f)[1]) for f in FEATURES])


@query(f"WITH {_DIGEST} SELECT feature, CAST(k AS INTEGER) AS k, round(below / n, 9) AS cdf_left, round(upto / n, 9) AS cdf_right FROM rc")
def cdf_left_right(spark, sf_dir):
    t = D.DistributionTracker(n_bins=BINS).fit(split(spark, sf_dir)[0], FEATURES)
    rows = [(f, k + 1, a / r["count"], b / r["count"]) for f in FEATURES for r in [t.reference[f]] for k, (a, b) in enumerate(zip(r["below"], r["upto"]))]
    return rounded(spark.createDataFrame(rows, "feature string, k int, cdf_left double, cdf_right double"), 9)


@query(f"WITH {_DIGEST} SELECT oor.feature, CAST(under AS BIGINT) AS under, CAST(over AS BIGINT) AS over, round((under + over) / mb.n, 9) AS out_of_range_fraction FROM oor JOIN mb USING (feature)")
def batch_histogram_oor(spark, sf_dir):
    t, report = tracked(spark, sf_dir)
    return rounded(spark.createDataFrame([(r["feature"], t.running[r["feature"]]["under"], t.running[r["feature"]]["over"], r["out_of_range_fraction"]) for r in report.rows], "feature string, under long, over long, out_of_range_fraction double"), 9)


@query(f"WITH {_DIGEST}, hr AS ({_hist('rc')}), hb AS ({_hist('bc')}) SELECT feature, bin, hr.rows + hb.rows AS rows FROM hr JOIN hb USING (feature, bin)")
def running_histogram(spark, sf_dir):
    t, _ = tracked(spark, sf_dir)
    return _bins(spark, [(f, t.running_histogram(f)[1]) for f in FEATURES])


@query(f"WITH {_DIGEST} SELECT feature, round(ks, 9) AS ks_statistic FROM ks")
def ks_grid(spark, sf_dir):
    return rounded(tracked(spark, sf_dir)[1].to_frame(spark).select("feature", "ks_statistic"), 9)


@query(f"WITH {_DIGEST} SELECT feature, round(p, 8) AS p_value FROM kp")
def ks_pvalue(spark, sf_dir):
    return rounded(tracked(spark, sf_dir)[1].to_frame(spark).select("feature", "p_value"), 8)


@query(f"""WITH {_DIGEST} SELECT kp.feature, round(ks, 6) AS ks_statistic, round(p, 6) AS p_value, round((mb.m - mo.m) / mo.s, 6) AS mean_shift, round(mb.s / mo.s, 6) AS std_ratio,
    round((under + over) / mb.n, 6) AS out_of_range_fraction, p < 0.01 AS drifted FROM kp JOIN mo USING (feature) JOIN mb USING (feature) JOIN oor USING (feature)""")
def drift_report(spark, sf_dir):
    return rounded(tracked(spark, sf_dir)[1].to_frame(spark))


@query(f"WITH {_DIGEST} SELECT count(*) FILTER (p < 0.01) AS drifted, round(avg(CAST(p < 0.01 AS INTEGER)), 6) AS fraction, avg(CAST(p < 0.01 AS INTEGER)) > 0.3 AS rebin FROM kp")
def drift_fraction(spark, sf_dir):
    r = tracked(spark, sf_dir)[1]
    return rounded(spark.createDataFrame([(len(r.drifted), r.fraction_drifted, r.needs_rebin)], "drifted long, fraction double, rebin boolean"))


@query(f"WITH {_DIGEST} SELECT mo.feature, round((mb.m - mo.m) / mo.s, 6) AS mean_shift, round(mb.s / mo.s, 6) AS std_ratio FROM mo JOIN mb USING (feature)")
def mean_shift_std_ratio(spark, sf_dir):
    return rounded(tracked(spark, sf_dir)[1].to_frame(spark).select("feature", "mean_shift", "std_ratio"))


@query("SELECT CAST(n AS BIGINT) AS n, round(CASE WHEN n > 0 AND n < 500 THEN greatest(0.01, least(0.01 * 500 / n, 0.1)) ELSE 0.01 END, 9) AS threshold FROM (SELECT count(*) AS n FROM lineitem GROUP BY date_trunc('month', l_shipdate))")
def effective_threshold(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate")).agg(F.count(F.lit(1)).alias("n")).select("n").collect()  # one row a month
    threshold = D.DistributionTracker().effective_threshold
    return rounded(spark.createDataFrame([(r["n"], float(threshold(r["n"]))) for r in months], "n long, threshold double"), 9)


@query("""WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, value FROM events WHERE isfinite(value)), f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM d WHERE day = (SELECT min(day) FROM d))
    SELECT day, count(*) AS rows, round((avg(value) - max(m)) / max(s), 6) AS mean_shift, round(stddev_pop(value) / max(s), 6) AS std_ratio FROM d, f GROUP BY day""")
def events_daily_drift(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), finite(F.col("value")).alias("value")).where("value IS NOT NULL")
    by = d.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    first = by.agg(F.min_by("m", "day").alias("m"), F.min_by("s", "day").alias("s")).first()
    return rounded(by.select("day", "rows", ((F.col("m") - F.lit(first["m"])) / F.lit(first["s"])).alias("mean_shift"), (F.col("s") / F.lit(first["s"])).alias("std_ratio")))


@query("WITH r AS (SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) AS i, count(*) OVER () AS n FROM lineitem) SELECT count(*) FILTER (i > n - h) AS held_out, count(*) FILTER (i <= n - h) AS trained, max(CASE WHEN i <= n - h THEN l_shipdate END) AS last_trained, min(CASE WHEN i > n - h THEN l_shipdate END) AS first_held_out FROM (SELECT *, CAST(round_even(n * 0.2, 0) AS BIGINT) AS h FROM r)")
def walkforward_split(spark, sf_dir):
    rows = rows_of(table(spark, sf_dir, "lineitem"), FEATURES, "l_extendedprice", None, "l_shipdate", limit=0)
    head, tail = rows.split(round(rows.n * 0.2))
    ends = [x.df.agg(f("o")).first()[0] for x, f in ((head, F.max), (tail, F.min))]
    return spark.createDataFrame([(tail.n, head.n, *ends)], "held_out long, trained long, last_trained timestamp_ntz, first_held_out timestamp_ntz")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('1|' || o_orderkey), o_orderkey LIMIT 1000")
def hash_subsample(spark, sf_dir):
    """A sampling operator: exactly 1000 rows, by a hash of the key."""
    return subsample(table(spark, sf_dir, "orders"), 1000, "o_orderkey", 1).select("o_orderkey", "o_totalprice")


# Metrics: y and a score from columns of lineitem.
_SCORED = "(SELECT l_discount * 10 AS y, l_tax * 8 AS raw, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS c, l_quantity / 50.0 AS s, l_linestatus FROM lineitem)"


def scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 8).alias("raw"), (F.col("l_returnflag") == "R").cast("double").alias("c"), (F.col("l_quantity") / 50.0).alias("s"), "l_linestatus")


@query(f"SELECT l_linestatus, round(sqrt(avg((y - raw) * (y - raw))), 6) AS value FROM {_SCORED} GROUP BY 1")
def metric_rmse(spark, sf_dir):
    return rounded(M.evaluate(scored(spark, sf_dir), "rmse", "y", "raw", ["l_linestatus"]))


@query(f"SELECT l_linestatus, round(avg(abs(y - raw)), 6) AS value FROM {_SCORED} GROUP BY 1")
def metric_mae(spark, sf_dir):
    return rounded(M.evaluate(scored(spark, sf_dir), "mae", "y", "raw", ["l_linestatus"]))


@query(f"SELECT l_linestatus, round(avg(ln(1 + exp(-abs(s))) + greatest(s, 0) - c * s), 6) AS value FROM {_SCORED} GROUP BY 1")
def metric_logloss(spark, sf_dir):
    return rounded(M.evaluate(scored(spark, sf_dir), "logloss", "c", "s", ["l_linestatus"]))


@query(f"SELECT l_linestatus, round(sqrt(avg(pow(c - 1 / (1 + exp(-s)), 2))), 6) AS rmse, round(avg(abs(c - 1 / (1 + exp(-s)))), 6) AS mae FROM {_SCORED} GROUP BY 1")
def metric_rmse_binary(spark, sf_dir):
    a, b = (M.evaluate(scored(spark, sf_dir), m, "c", "s", ["l_linestatus"], 1.0, "binary").withColumnRenamed("value", m) for m in ("rmse", "mae"))
    return rounded(a.join(b, "l_linestatus"))


_AUC = "WITH r AS (SELECT {g} c, {s} AS s, rank() OVER ({p} ORDER BY {s}) + (count(*) OVER (PARTITION BY {g} {s}) - 1) / 2.0 AS k FROM {t}) SELECT {g} round((sum(k) FILTER (c = 1) - count(*) FILTER (c = 1) * (count(*) FILTER (c = 1) + 1) / 2.0) / (count(*) FILTER (c = 1) * CAST(count(*) FILTER (c = 0) AS DOUBLE)), 6) AS value FROM r {e}"


@query(_AUC.format(g="l_linestatus,", s="s", p="PARTITION BY l_linestatus", t=_SCORED, e="GROUP BY l_linestatus HAVING count(DISTINCT c) = 2") + " UNION ALL SELECT l_linestatus, NULL FROM " + _SCORED + " GROUP BY 1 HAVING count(DISTINCT c) < 2")
def metric_auc(spark, sf_dir):
    return rounded(M.evaluate(scored(spark, sf_dir), "auc", "c", "s", ["l_linestatus"]))


@query(f"SELECT round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, count(d) AS n, avg(d) < 0 AND avg(d) < -2 * stddev_samp(d) / sqrt(count(d)) AS passes FROM (SELECT (y - raw) * (y - raw) - (y - 0.5) * (y - 0.5) AS d FROM {_SCORED})")
def row_loss_zgate(spark, sf_dir):
    d = M.row_loss("rmse", F.col("y"), F.col("raw")) - M.row_loss("rmse", F.col("y"), F.lit(0.5))
    r = scored(spark, sf_dir).agg(*M.z_gate(d))
    return rounded(r.withColumn("passes", (F.col("mean") < 0) & (F.col("mean") < -2 * F.col("sd") / F.sqrt("n"))))


@query(f"SELECT l_linestatus, round(sum(1 / (1 + exp(-s))), 4) AS binary, round(sum(exp(s)), 4) AS poisson, round(sum(s), 4) AS identity FROM {_SCORED} GROUP BY 1")
def prediction_transform(spark, sf_dir):
    d = scored(spark, sf_dir)
    return rounded(d.groupBy("l_linestatus").agg(*[F.sum(M.transform(k, F.col("s"))).alias(n) for k, n in (("binary", "binary"), ("poisson", "poisson"), ("regression", "identity"))]), 4)


@query(f"SELECT round(1 - sum((y - raw) * (y - raw)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM {_SCORED}")
def r2_score(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(M.r2(F.col("y"), F.col("raw")), 6).alias("r2"))


# Ensembles: stumps (feature, threshold, value at or below, value above, gain); the target is l_discount * 10.
STUMPS = [("l_quantity", 25.0, 0.45, 0.55, 9.0), ("l_extendedprice", 40000.0, 0.02, -0.03, 7.5), ("l_tax", 0.04, -0.05, 0.06, 4.0), ("l_quantity", 10.0, 0.08, -0.01, 2.5), ("l_discount", 0.05, -0.2, 0.2, 30.0), ("l_tax", 0.02, 0.07, 0.01, 1.25)]
_TREES = ", ".join(f"({t}, CASE WHEN {f} <= {c} THEN {a} ELSE {b} END)" for t, (f, c, a, b, _) in enumerate(STUMPS))
_OUT = f"SELECT l_orderkey, l_linenumber, l_discount * 10 AS y, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS c, " + ", ".join(f"CAST(CASE WHEN {f} <= {c} THEN {a} ELSE {b} END AS DOUBLE) AS t{t}" for t, (f, c, a, b, _) in enumerate(STUMPS)) + " FROM lineitem"
_SUM = " + ".join(f"t{t}" for t in range(len(STUMPS)))
_LOO = f"o AS ({_OUT}), b AS (SELECT sqrt(avg(pow(y - ({_SUM}), 2))) AS base FROM o), s AS (" + " UNION ALL ".join(f"SELECT {t} AS tree_id, sqrt(avg(pow(y - ({_SUM} - t{t}), 2))) - max(base) AS score FROM o, b" for t in range(len(STUMPS))) + ")"


def stump(f: str, c: float, a: float, b: float, g: float) -> tuple:
    return ((False, f, c, 1, 2, g, 0.0, False), (True, None, 0.0, 0, 0, 0.0, a, False), (True, None, 0.0, 0, 0, 0.0, b, False))


def stumps(objective: str = "regression") -> E.Ensemble:
    return E.Ensemble(tuple(FEATURES), tuple(stump(*x) for x in STUMPS), objective)


def outputs(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_discount") * 10).withColumn("c", (F.col("l_returnflag") == "R").cast("double"))
    return E.with_raw(rows, stumps(), per_tree="out").select("l_orderkey", "l_linenumber", "y", "c", "out")


@query("SELECT round(avg(CAST((l_quantity > 25) = (l_returnflag = 'R') AS INTEGER)), 6) AS accuracy, round(sum(l_tax * CAST((l_quantity > 25) = (l_returnflag = 'R') AS INTEGER)) / sum(l_tax), 6) AS weighted FROM lineitem")
def accuracy_score(spark, sf_dir):
    m = IncrementalBooster(task="classification")
    m.classes_, m.features_ = ["N", "R"], FEATURES
    m.ensemble_ = E.Ensemble(tuple(FEATURES), (stump("l_quantity", 25.0, -0.3, 0.4, 1.0),), "binary")
    rows = table(spark, sf_dir, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") == "R", "R").otherwise("N"))
    return rounded(spark.createDataFrame([(m.score(rows, "flag"), m.score(rows, "flag", "l_tax"))], "accuracy double, weighted double"))


@query(f"WITH o AS ({_OUT}) SELECT round(sqrt(avg(pow(y - t0 - t1, 2))), 6) AS ours, round(sqrt(avg(pow(y - t5, 2))), 6) AS naive, avg(pow(y - t0 - t1, 2) - pow(y - t5, 2)) < -1.645 * stddev_samp(pow(y - t0 - t1, 2) - pow(y - t5, 2)) / sqrt(count(*)) AS take_ours FROM o")
def naive_vs_ours_gate(spark, sf_dir):
    rows = rows_of(table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_discount") * 10), FEATURES, limit=0)
    keep_naive, ours, naive = IncrementalBooster()._naive_wins(rows, stumps().keep([0, 1]), stumps().keep([5]))
    return rounded(spark.createDataFrame([(ours, naive, not keep_naive)], "ours double, naive double, take_ours boolean"))


@query(f"WITH o AS ({_OUT}) SELECT l_orderkey, l_linenumber, round({_SUM}, 6) AS raw FROM o")
def stump_raw_score(spark, sf_dir):
    return rounded(E.with_raw(table(spark, sf_dir, "lineitem"), stumps()).select("l_orderkey", "l_linenumber", "raw"))


@query(f"WITH o AS ({_OUT}) " + " UNION ALL ".join(f"SELECT {t} AS tree_id, round(sum(t{t}), 4) AS total, round(min(t{t}), 6) AS low, round(max(t{t}), 6) AS high FROM o" for t in range(len(STUMPS))))
def per_tree_output(spark, sf_dir):
    each = outputs(spark, sf_dir).select(F.posexplode("out").alias("tree_id", "o"))
    r = each.groupBy("tree_id").agg(F.sum("o").alias("total"), F.min("o").alias("low"), F.max("o").alias("high"))
    return r.select("tree_id", F.round("total", 4).alias("total"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {_LOO} SELECT tree_id, round(score, 8) AS score FROM s")
def loo_contributions(spark, sf_dir):
    return rounded(E.loo_scores(outputs(spark, sf_dir), "rmse", n_trees=len(STUMPS)), 8)


_P = lambda x: f"(1 / (1 + exp(-({x}))))"


@query(f"WITH o AS ({_OUT}), b AS (SELECT sqrt(avg(pow(c - {_P(_SUM)}, 2))) AS base FROM o) " + " UNION ALL ".join(f"SELECT {t} AS tree_id, round(sqrt(avg(pow(c - {_P(f'{_SUM} - t{t}')}, 2))) - max(base), 8) AS score FROM o, b" for t in range(len(STUMPS))))
def loo_rmse_binary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("c", (F.col("l_returnflag") == "R").cast("double"))
    m = E.TreeManager(stumps("binary"))
    m.score_trees(rows_of(rows, FEATURES, "c", limit=0), metric="rmse")
    return rounded(spark.createDataFrame([(t, x) for t, x in enumerate(m.scores)], "tree_id int, score double"), 8)


_LOO_AUC = "WITH o AS (" + _OUT + "), l AS (SELECT c, -1 AS tree_id, round(" + _SUM + ", 9) AS s FROM o " + " ".join(f"UNION ALL SELECT c, {t}, round({_SUM} - t{t}, 9) FROM o" for t in range(len(STUMPS))) + "), r AS (SELECT c, tree_id, rank() OVER (PARTITION BY tree_id ORDER BY s) + (count(*) OVER (PARTITION BY tree_id, s) - 1) / 2.0 AS k FROM l), a AS (SELECT tree_id, (sum(k) FILTER (c = 1) - count(*) FILTER (c = 1) * (count(*) FILTER (c = 1) + 1) / 2.0) / (count(*) FILTER (c = 1) * CAST(count(*) FILTER (c = 0) AS DOUBLE)) AS auc FROM r GROUP BY 1) SELECT tree_id, round((SELECT auc FROM a WHERE tree_id = -1) - auc, 8) AS score FROM a WHERE tree_id >= 0"


@query(_LOO_AUC)
def loo_auc(spark, sf_dir):
    # Sums of outputs are rounded so that ties do not depend on the order of summation.
    o = outputs(spark, sf_dir).select("c", F.aggregate("out", F.lit(0.0), lambda a, v: a + v).alias("raw"), "out")
    base = M.auc(o.select("c", F.round("raw", 9).alias("s")), "c", "s").first()["auc"]
    each = o.select("c", "raw", F.posexplode("out").alias("tree_id", "o")).select("tree_id", "c", F.round(F.col("raw") - F.col("o"), 9).alias("s"))
    return M.auc(each, "c", "s", ["tree_id"]).select("tree_id", F.round(F.lit(base) - F.col("auc"), 8).alias("score"))


def managed(spark, sf_dir) -> E.TreeManager:
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_discount") * 10)
    m = E.TreeManager(stumps())
    m.score_trees(rows_of(rows, FEATURES, limit=0))
    return m


def _ids(spark, ids) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "place int, tree_id int")


@query(f"WITH {_LOO} SELECT CAST(row_number() OVER (ORDER BY score DESC, tree_id) - 1 AS INTEGER) AS place, tree_id FROM s")
def tree_ranking(spark, sf_dir):
    return _ids(spark, managed(spark, sf_dir).ranking())


@query(f"WITH {_LOO} SELECT CAST(row_number() OVER (ORDER BY score, tree_id) - 1 AS INTEGER) AS place, tree_id FROM s WHERE score < 0")
def identify_retiring(spark, sf_dir):
    return _ids(spark, managed(spark, sf_dir).identify_retiring())


@query(f"WITH {_LOO} SELECT CAST(row_number() OVER (ORDER BY score, tree_id) - 1 AS INTEGER) AS place, tree_id FROM s WHERE tree_id <> 1 ORDER BY score, tree_id LIMIT 3")
def lowest_scoring(spark, sf_dir):
    return _ids(spark, managed(spark, sf_dir).lowest_scoring(3, [1]))


def _greedy(z: float, cap: int) -> str:
    """The trees below zero, lowest first, each tested on top of those taken before; one step of SQL a tree."""
    steps, n = [], len(STUMPS)
    columns = "y, " + ", ".join(f"t{t}" for t in range(n))
    before = f"SELECT {columns}, {_SUM} AS f FROM o"
    for k in range(1, n + 1):
        tree = f"(SELECT tree_id FROM cand WHERE k = {k})"
        taken = " + ".join([f"(SELECT CAST(ok AS INTEGER) FROM g{j})" for j in range(1, k)] or ["0"])
        value = " ".join(f"WHEN {t} THEN t{t}" for t in range(n))
        steps.append(f"r{k} AS (SELECT *, f - CASE {tree} {value} END AS trial FROM ({before}))")
        steps.append(f"g{k} AS (SELECT {k} AS k, coalesce(avg(d) < 0 AND avg(d) < -{z} * stddev_samp(d) / sqrt(count(d)), false) AND {taken} < {cap} AS ok FROM (SELECT pow(y - trial, 2) - pow(y - f, 2) AS d FROM r{k}))")
        before = f"SELECT {columns}, CASE WHEN (SELECT ok FROM g{k}) THEN trial ELSE f END AS f FROM r{k}"
    picks = " UNION ALL ".join(f"SELECT k, ok FROM g{k}" for k in range(1, n + 1))
    return f"WITH {_LOO}, cand AS (SELECT tree_id, row_number() OVER (ORDER BY score, tree_id) AS k FROM s WHERE score < 0), " + ", ".join(steps) + f" SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS place, tree_id FROM ({picks}) JOIN cand USING (k) WHERE ok"


@query(_greedy(2.0, 3))
def select_retirement_greedy(spark, sf_dir):
    return _ids(spark, managed(spark, sf_dir).select_retirement(min_z=2.0))


_NODES = "(VALUES " + ", ".join(f"({t}, '{f}', CAST({c} AS DOUBLE), CAST({g} AS DOUBLE), CAST({a} + {b} AS DOUBLE))" for t, (f, c, a, b, g) in enumerate(STUMPS)) + ") n(tree_id, feature, threshold, gain, leaves)"


@query(f"SELECT CAST(dense_rank() OVER (ORDER BY tree_id) - 1 AS INTEGER) AS tree_id, feature, threshold, gain FROM {_NODES} WHERE tree_id NOT IN (1, 3)")
def retire_trees_antijoin(spark, sf_dir):
    nodes = stumps().to_frame(spark)
    left = E.retire_nodes(nodes, spark.createDataFrame([(1,), (3,)], "tree_id int"))
    return left.where(~F.col("is_leaf")).select("tree_id", "feature", "threshold", "gain")


@query(f"SELECT tree_id, feature, sum(gain) AS gain, count(*) AS splits FROM {_NODES} GROUP BY ALL")
def per_tree_gain(spark, sf_dir):
    return E.per_tree_importance(stumps().to_frame(spark))


@query(f"SELECT feature, sum(gain) AS gain, count(*) AS splits FROM {_NODES} GROUP BY ALL")
def feature_gain(spark, sf_dir):
    return E.per_tree_importance(stumps().to_frame(spark)).groupBy("feature").agg(F.sum("gain").alias("gain"), F.sum("splits").alias("splits"))


_PAIRS = [tuple(sorted((a, b))) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, round(coalesce(corr({a}, {b}), 0), 6) AS rho FROM lineitem" for a, b in _PAIRS))
def pearson_matrix(spark, sf_dir):
    return rounded(I.correlation_pairs(table(spark, sf_dir, "lineitem"), FEATURES, "pearson"))


def _spearman(a: str, b: str, where: str, cols: str = "*") -> str:
    rank = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    return f"SELECT '{a}' AS f1, '{b}' AS f2, round(coalesce(corr(x, y), 0), 6) AS rho FROM (SELECT {rank('u')} AS x, {rank('v')} AS y FROM (SELECT {a} AS u, {b} AS v FROM {where}) WHERE u IS NOT NULL AND v IS NOT NULL)"


@query(" UNION ALL ".join(_spearman(a, b, "lineitem") for a, b in _PAIRS))
def spearman_matrix(spark, sf_dir):
    return rounded(I.correlation_pairs(table(spark, sf_dir, "lineitem"), FEATURES, "spearman"))


_GAPS = "(SELECT CASE WHEN l_quantity <= 45 THEN l_quantity END AS a, CASE WHEN l_discount > 0 THEN l_extendedprice END AS b, l_tax AS c, CAST(1 AS DOUBLE) AS k FROM lineitem)"


@query(" UNION ALL ".join(_spearman(a, b, _GAPS) for a, b in (("a", "b"), ("a", "c"), ("a", "k"), ("b", "c"), ("b", "k"), ("c", "k"))).replace("coalesce(corr(x, y), 0)", "CASE WHEN var_pop(x) * var_pop(y) > 0 THEN corr(x, y) ELSE 0 END"))
def pairwise_complete_corr(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("b"), F.col("l_tax").alias("c"), F.lit(1.0).alias("k"))
    return rounded(I.correlation_pairs(r, ["a", "b", "c", "k"], "spearman"))


@query()
def cluster_average(spark, sf_dir):
    c = I.matrix_of(I.correlation_pairs(table(spark, sf_dir, "lineitem"), FEATURES, "spearman"), FEATURES)
    return spark.createDataFrame([(k, f) for k, m in I.cluster(c, FEATURES, 0.5, "average").items() for f in m], "cluster int, feature string")


_CLUSTERS = "(VALUES (0, 'l_quantity'), (0, 'l_extendedprice'), (1, 'l_discount'), (2, 'l_tax')) c(cluster, feature)"


@query(f"WITH g AS (SELECT feature, sum(gain) AS gain FROM {_NODES} GROUP BY 1), t AS (SELECT cluster, sum(coalesce(gain, 0)) AS importance, count(*) AS n_features FROM {_CLUSTERS} LEFT JOIN g USING (feature) GROUP BY 1) SELECT cluster, importance, round(importance / sum(importance) OVER (), 6) AS share, CAST(n_features AS INTEGER) AS n_features FROM t")
def cluster_importance(spark, sf_dir):
    return rounded(_report(spark, sf_dir).to_frame(spark).select("cluster", "importance", "share", "n_features"))


@query(f"WITH g AS (SELECT feature, sum(gain) AS gain FROM {_NODES} GROUP BY 1) SELECT feature, cluster, round(gain / sum(gain) OVER (PARTITION BY cluster), 6) AS intra_cluster_share, gain AS raw_importance FROM {_CLUSTERS} JOIN g USING (feature)")
def intra_cluster_share(spark, sf_dir):
    return rounded(_report(spark, sf_dir).feature_frame(spark))


def _report(spark, sf_dir, **options) -> I.ImportanceReport:
    """With given clusters: quantity and price are taken as dependent."""
    corr = np.eye(len(FEATURES))
    corr[0, 1] = corr[1, 0] = 0.9
    options = {"correlation": corr} | options
    return I.ClusteredImportance(max_samples=1 << 40).compute(stumps(), table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_discount") * 10), **options)


# Monthly totals by return flag and status serve as importance snapshots of "clusters".
_SNAP = "WITH q AS (SELECT date_trunc('year', l_shipdate) AS t, l_returnflag || l_linestatus AS c, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL), g AS (SELECT t, c, coalesce(v, 0) AS v FROM (SELECT DISTINCT t FROM q) CROSS JOIN (SELECT DISTINCT c FROM q) LEFT JOIN q USING (t, c)), p AS (SELECT a.t, a.c AS c1, b.c AS c2, sign(a.v - b.v) AS s FROM g a JOIN g b ON a.t = b.t AND a.c <> b.c), l AS (SELECT *, lead(s) OVER (PARTITION BY c1, c2 ORDER BY t) AS z FROM p)"


def snapshots(spark, sf_dir) -> DataFrame:
    """(t, c, v), with 0 where a group has no row in a year."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("year", "l_shipdate").alias("t"), F.concat("l_returnflag", "l_linestatus").alias("c")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    wide = q.groupBy("t").pivot("c").agg(F.first("v")).na.fill(0.0)  # years times groups
    return wide.unpivot("t", [c for c in wide.columns if c != "t"], "c", "v")


@query(f"{_SNAP} SELECT c1 AS cluster, round(avg(CASE WHEN s = z THEN 1.0 WHEN s * z < 0 THEN -1.0 ELSE 0.0 END), 6) AS stability FROM l WHERE z IS NOT NULL GROUP BY 1")
def stability_per_cluster(spark, sf_dir):
    return rounded(I.cluster_stability(snapshots(spark, sf_dir)).withColumnRenamed("c", "cluster"))


@query(f"{_SNAP} SELECT round(avg(tau), 6) AS overall_stability FROM (SELECT t, sum(s * z) / sqrt(sum(abs(s)) * sum(abs(z))) AS tau FROM l WHERE z IS NOT NULL GROUP BY t HAVING sum(abs(s)) * sum(abs(z)) > 0)")
def kendall_tau_b(spark, sf_dir):
    return rounded(I.overall_stability(snapshots(spark, sf_dir)))


@query()
def permutation_importance(spark, sf_dir):
    return _report(spark, sf_dir, y="y").to_frame(spark).select("cluster", "permutation_importance", "features")


@query()
def mutual_info(spark, sf_dir):
    c = I.ClusteredImportance("mutual_info").correlation(clean(table(spark, sf_dir, "lineitem"), FEATURES))
    return spark.createDataFrame([(a, b, float(c[i, j])) for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j], "f1 string, f2 string, rho double")


# Each year but the last as reference of the last one, by the digest, the statistic and the rule of _DIGEST.
_YEARS = f"""WITH v AS ({" UNION ALL ".join(f"SELECT year(l_shipdate) AS y, '{f}' AS feature, {f} AS value FROM lineitem" for f in FEATURES)}),
    last AS (SELECT max(y) AS y FROM v), bv AS (SELECT feature, value FROM v JOIN last USING (y)),
    r AS (SELECT v.y, feature, value, row_number() OVER (PARTITION BY v.y, feature ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY v.y, feature) AS n FROM v, last WHERE v.y < last.y),
    lv AS (SELECT DISTINCT y, feature, n, k, CAST(k AS DOUBLE) / {BINS}.0 * (n - 1) AS pos FROM r, range({BINS + 1}) t(k)),
    ends AS (SELECT y, feature, k, pos, 0 AS side, CAST(floor(pos) AS BIGINT) AS i FROM lv UNION ALL SELECT y, feature, k, pos, 1, least(CAST(floor(pos) AS BIGINT) + 1, n - 1) FROM lv),
    qt AS (SELECT y, feature, k, max(pos) AS pos, max(CASE WHEN side = 0 THEN value END) AS lo, max(CASE WHEN side = 1 THEN value END) AS hi FROM ends JOIN r USING (y, feature, i) GROUP BY y, feature, k),
    ed AS (SELECT DISTINCT y, feature, lo + (pos - floor(pos)) * (hi - lo) AS edge FROM qt),
    rc AS (SELECT ed.y, feature, edge, count(*) FILTER (value < edge) AS below, count(*) FILTER (value <= edge) AS upto, count(*) AS n FROM ed JOIN r USING (y, feature) GROUP BY ALL),
    bc AS (SELECT ed.y, feature, edge, count(*) FILTER (value < edge) AS below, count(*) FILTER (value <= edge) AS upto, count(*) AS n FROM ed JOIN bv USING (feature) GROUP BY ALL),
    ks AS (SELECT rc.y, feature, max(greatest(abs(rc.below / rc.n - bc.below / bc.n), abs(rc.upto / rc.n - bc.upto / bc.n))) AS ks, max(rc.n) AS nr, max(bc.n) AS nb FROM rc JOIN bc USING (y, feature, edge) GROUP BY ALL),
    kx AS (SELECT *, (sqrt(nr * nb / (nr + nb)) + 0.12 + 0.11 / sqrt(nr * nb / (nr + nb))) * ks AS x FROM ks),
    kp AS (SELECT *, CASE WHEN x <= 0.1 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * x * x))))) END AS p,
           CASE WHEN nb < 500 THEN greatest(0.01, least(0.01 * 500 / nb, 0.1)) ELSE 0.01 END AS bar FROM kx)"""


@query(f"{_YEARS} SELECT CAST(y AS INTEGER) AS year, NOT avg(CAST(p < bar AS INTEGER)) > 0.3 AS compatible FROM kp GROUP BY 1")
def compatible_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), *FEATURES)
    years = sorted(r["year"] for r in rows.select("year").distinct().collect())
    of = {y: rows_of(rows.where(F.col("year") == y), FEATURES, "l_extendedprice") for y in years}
    m = IncrementalBooster(n_bins=BINS)
    m.features_, m.stored_ = FEATURES, [of[y] for y in years[:-1]]
    kept = m._compatible(of[years[-1]])
    return spark.createDataFrame([(y, any(of[y] is k for k in kept)) for y in years[:-1]], "year int, compatible boolean")


_LEARNED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _followed(spark, sf_dir) -> tuple[IncrementalBooster, DataFrame]:
    """The price of a line from the rest of it, learned year by year."""
    df = table(spark, sf_dir, "lineitem").select("l_shipdate", F.year("l_shipdate").alias("year"), (F.col("l_extendedprice") / 1000).alias("y"), *_LEARNED)
    m = IncrementalBooster(n_estimators_per_batch=6, num_leaves=7, n_bins=32, max_bin=64, store_recent_data=False)
    for year in sorted(r["year"] for r in df.select("year").distinct().collect()):
        m.partial_fit(df.where(F.col("year") == year), "y", _LEARNED, order="l_shipdate")
    return m, df.select("y", *_LEARNED)


@query()
def partial_fit_history(spark, sf_dir):
    h = _followed(spark, sf_dir)[0].history(spark)
    return rounded(h.select("batch", "stage", "action", "n_rows", "validation", "n_drifted_features", "trees_before", "trees_retired", "trees_added", "trees_after", "metric", "prequential_loss", "candidate_loss_ours", "candidate_loss_naive"))


@query()
def feature_importance_report(spark, sf_dir):
    m, df = _followed(spark, sf_dir)
    return m.feature_importance_report(df).to_frame(spark)
