"""Helpers shared by the corpus operators: the shared folder, written tables, and running sums without a hot task."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: White space as the contracts define it, and what lies between white space.
WS = r"[\x20\x09-\x0D]+"
TOKEN = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only when its measured size is below this; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20

_own_dirs: dict[str, str] = {}
_records: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset: a temporary folder under a local master (tests), else one in the warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        local = spark.sparkContext.master.startswith("local")
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidemark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"
    return _own_dirs[app]


def materialize(df: DataFrame, tag: str, *by: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (a folder for each value of ``by``) to the shared folder and read it again.

    Cuts the lineage, and survives lost executors. What nobody deletes before goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    for record in _records:
        record.append(path)
    df.write.partitionBy(*by).options(**({"compression": "zstd"} | options)).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded(paths: list[str]):
    """Add to ``paths`` the tables written inside."""
    _records.append(paths)
    try:
        yield
    finally:
        _records.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str], keep: list[str]) -> None:
    """Delete written tables, but for those that hold one of the files ``keep``; empties ``paths``."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if not any(path.rsplit("/", 1)[1] in f for f in keep):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    paths.clear()


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` of ``row_bytes`` stay under BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def cells_for(rows: int, per_cell: int = 20_000, least: int = 16) -> int:
    """Number of hash cells that keeps a cell near ``per_cell`` rows at every input size."""
    return max(least, -(-rows // per_cell))


def running_total(df: DataFrame, keys: list[str], order: str, tie: str, cells: int, weight: str | None = None, out: str = "position") -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 if None) over the rows before this one within ``keys``.

    Rows go by (hash of ``order``, ``tie``). A key's rows are dealt over ``cells`` ranges of the hash; each
    range is summed by itself and starts at the total of the ranges before it, so a key that holds a third
    of the table still spreads over all tasks. At most ``cells`` rows of a key meet in the window of totals.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    hashed = df.withColumn("_hash", F.xxhash64(F.col(order))).withColumn("_cell", F.floor(F.shiftrightunsigned(F.col("_hash"), 32).cast("double") / float(1 << 32) * cells).cast("long"))
    totals = hashed.groupBy(*keys, "_cell").agg(F.sum(w).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    on = [hashed[k].eqNullSafe(starts[f"_k_{k}"]) for k in keys] + [hashed["_cell"] == starts["_c"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    inner = Window.partitionBy(*keys, "_cell").orderBy("_hash", tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = hashed.join(starts, cond)
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(w).over(inner), F.lit(0).cast("long"))).drop("_hash", "_cell", "_c", "_start", *[f"_k_{k}" for k in keys])
