"""Tables written to the folder that driver and executors share, instead of lineage or caches."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder under a local master (tests), else one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        local = spark.sparkContext.master.startswith("local")
        _own[app] = tempfile.mkdtemp(prefix="tidemark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"
    return _own[app]


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table, read again: survives lost executors, and goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, fs = _fs(spark, path)
    fs.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _fs(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder in one step; False if ``new`` is there already."""
    a, fs = _fs(spark, old)
    b, _ = _fs(spark, new)
    return not fs.exists(b) and fs.rename(a, b)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it is not there."""
    target, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target) if x.isDirectory()) if fs.exists(target) else []


def pandas_of(df: DataFrame) -> pd.DataFrame:
    """A table of bounded size on the driver, through Arrow whatever the session says."""
    return df.toArrow().to_pandas()


def frame_of(spark: SparkSession, rows: pd.DataFrame) -> DataFrame:
    """Rows of the driver as a DataFrame, through Arrow."""
    return spark.createDataFrame(pa.Table.from_pandas(rows, preserve_index=False))
