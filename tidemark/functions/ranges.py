"""Running sums in the order of a value without a window over a whole column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Ranges that a group's values are dealt over, from an approximate quantile sketch.
CELLS = 64


def _cell(value: str, cuts: str) -> Column:
    """How many of the CELLS - 1 cuts are at or below the value, by binary search without branches (it compiles)."""
    cell, step = F.lit(0), CELLS // 2
    while step:
        cell = cell + F.lit(step) * (F.get(F.col(cuts), cell + F.lit(step - 1)) <= F.col(value)).cast("int")
        step //= 2
    return cell


def running_before(counts: DataFrame, by: list[str], value: str, weight: str, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same group ``by`` with a smaller value.

    counts: one row for each group and value, values not null. A group's values are dealt over CELLS ranges at
    approximate quantiles; each range is summed by itself and starts at the total of those before, so no task holds
    a group. What is broadcast has CELLS numbers a group, and groups are few (features, trees, pairs of features).
    """
    keyed = counts.withColumn("_g", F.struct(*by) if by else F.lit(0))
    levels = [i / CELLS for i in range(1, CELLS)]
    cuts = keyed.groupBy("_g").agg(F.percentile_approx(F.col(value).cast("double"), levels, 2000).alias("_cuts")).withColumnRenamed("_g", "_h")
    celled = keyed.join(F.broadcast(cuts), F.col("_g") == F.col("_h")).withColumn("_cell", _cell(value, "_cuts")).drop("_cuts", "_h")
    before = Window.partitionBy("_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy("_g", "_cell").agg(F.sum(weight).alias("_s")).select(F.col("_g").alias("_h"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_g", "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = celled.join(F.broadcast(starts), (F.col("_g") == F.col("_h")) & (F.col("_cell") == F.col("_c")))
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(weight).over(inner), F.lit(0))).drop("_g", "_h", "_c", "_cell", "_start")


def average_ranks(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Add ranks from 1 within the groups ``by``, with the mean rank for ties. Values and ``by`` must not be null.

    Distinct values are counted and ranked by ranges, then joined to the rows: few values are broadcast, many are spread
    by their hash, and Spark splits a value that holds many rows.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_before(counts, by, value, "_n", "_before")
    table = ranked.select(*[F.col(c).alias(f"_r_{c}") for c in (*by, value)], (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    same = [F.col(c) == F.col(f"_r_{c}") for c in (*by, value)]
    return df.join(table, reduce(Column.__and__, same)).drop(*[f"_r_{c}" for c in (*by, value)])
