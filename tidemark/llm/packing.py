"""Packing into length buckets whose boundaries minimise padding over the global length histogram."""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame, functions as F

from .common import TOKEN, cells_for, materialize, running_total

BUDGET, BUCKETS = 32_768, 16


def optimal_boundaries(bins: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Boundaries (each the longest length of its bucket) minimising the padding of all rows.

    bins: (longest length, rows, sum of lengths), by length. Dynamic programming over the bins; as a bucket's
    padding is ``top * rows - sum``, a layer is a lower envelope of lines and takes linear time.
    """
    n = len(bins)
    if not n:
        return []
    rows, sums = [0], [0]
    for _, c, s in bins:
        rows.append(rows[-1] + c)
        sums.append(sums[-1] + s)
    tops = [b[0] for b in bins]
    best = [tops[j] * rows[j + 1] - sums[j + 1] for j in range(n)]
    came = [array("q", [-1]) * n]
    for _ in range(1, min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, the bin the last bucket starts after
        at, new, back = 0, list(best), array("q", [-2]) * n
        for j in range(n):
            if j:
                i = j - 1
                line = (-rows[i + 1], best[i] + sums[i + 1], i)
                while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]) >= (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
                x = tops[j]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                value = hull[at][0] * x + hull[at][1] + tops[j] * rows[j + 1] - sums[j + 1]
                if value < new[j]:
                    new[j], back[j] = value, hull[at][2]
        best = new
        came.append(back)
    out, j, k = [], n - 1, len(came) - 1
    while j >= 0:
        while came[k][j] == -2:  # this bin gains nothing from one more bucket
            k -= 1
        out.append(tops[j])
        j, k = came[k][j], k - 1
    return out[::-1]


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, length, bucket, boundary, batch, slot, capacity, padding for every document.

    Length is the number of words (null or empty text: 0). Each bucket's documents, in hash order, fill
    batches of ``budget // boundary`` rows (one at least, so a document over the budget is a batch by itself);
    only a bucket's last batch is not full. Documents of one length are never parted by a boundary; null ids and
    repeated rows are packed as often as they occur; other columns are ignored, whatever their names; an empty
    table gives no rows.

    The histogram has a bin for every length that occurs, so the boundaries are the best there are. Lengths
    0 to L - 1 take L (L - 1) / 2 words at least, so it never has more than 1 + sqrt(2 * words) rows: 5.7 million
    numbers at most for 16 * 10^12 words (100 TB), some 100,000 for documents of usual lengths.
    """
    spark = docs.sparkSession
    length = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long")
    slim = materialize(docs.select("doc_id", length.alias("length"), F.monotonically_increasing_id().alias("_uid")), "lengths")
    histogram = slim.groupBy("length").agg(F.count(F.lit(1)).alias("rows")).collect()
    tops = optimal_boundaries(sorted((r["length"], r["rows"], r["length"] * r["rows"]) for r in histogram), buckets)
    total = sum(r["rows"] for r in histogram)
    if not tops:
        return slim.select("doc_id", "length", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"), F.lit("").alias("batch"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("padding"))
    which = F.lit(len(tops) - 1)
    for i in range(len(tops) - 2, -1, -1):
        which = F.when(F.col("length") <= tops[i], F.lit(i)).otherwise(which)
    placed = slim.withColumn("bucket", which).withColumn("boundary", F.element_at(F.array(*[F.lit(t).cast("long") for t in tops]), F.col("bucket") + 1)).withColumn("_order", F.coalesce("doc_id", "_uid"))
    counted = running_total(placed, ["bucket"], "_order", "_uid", cells_for(total), None, "at")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    return counted.withColumn("capacity", capacity).select(
        "doc_id", "length", "bucket", "boundary",
        F.concat_ws("-", F.col("bucket"), F.floor(F.col("at") / F.col("capacity")).cast("long")).alias("batch"),
        (F.col("at") % F.col("capacity")).cast("long").alias("slot"), "capacity", (F.col("boundary") - F.col("length")).alias("padding"))
