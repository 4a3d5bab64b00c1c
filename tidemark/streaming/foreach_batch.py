"""Drift tracking and incremental learning on streams: one update a micro-batch, each applied once.

After each micro-batch the whole state is written to a folder of its own, which gets its final name, the batch's
number, in one step; so a folder with a number is complete. A writer starts from the newest such folder, whatever
process wrote it, and leaves out micro-batches up to its number: those are sent again after a failure.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..functions import tables
from ..operators.drift import DistributionTracker, DriftReport
from ..operators.model import IncrementalBooster

#: Complete states that are kept; older ones are deleted.
KEPT = 2


def newest(spark: SparkSession, state_path: str) -> int:
    """The number of the newest complete state, -1 if there is none."""
    return max((int(n) for n in tables.folders(spark, state_path) if re.fullmatch(r"\d+", n)), default=-1)


def _publish(spark: SparkSession, state_path: str, number: int, save: Callable[[str], None]) -> None:
    fresh = f"{state_path}/_{uuid.uuid4().hex}"
    save(fresh)
    if not tables.rename(spark, fresh, f"{state_path}/{number}"):
        raise RuntimeError(f"state {number} in {state_path} was published by another writer")
    for name in tables.folders(spark, state_path):
        if name.startswith("_") or (name.isdigit() and int(name) <= number - KEPT):
            tables.delete(spark, f"{state_path}/{name}")


def _writer(stream: DataFrame, state_path: str, restore: Callable[[str], None], update: Callable[[DataFrame, int], None], save: Callable[[str], None]) -> DataStreamWriter:
    spark = stream.sparkSession
    done = {"last": newest(spark, state_path)}
    if done["last"] >= 0:
        restore(f"{state_path}/{done['last']}")

    def apply(batch: DataFrame, number: int) -> None:
        if number <= done["last"] or batch.isEmpty():
            return
        update(batch, number)
        _publish(spark, state_path, number, save)
        done["last"] = number

    return stream.writeStream.foreachBatch(apply)


def track(stream: DataFrame, tracker: DistributionTracker, state_path: str, on_report: Callable[[int, DriftReport], None] | None = None) -> DataStreamWriter:
    """A writer that updates the tracker with each micro-batch; ``tracker`` takes over a state found in ``state_path``."""
    spark = stream.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        report = tracker.update(batch)
        if on_report:
            on_report(number, report)

    return _writer(stream, state_path, lambda path: tracker.__dict__.update(DistributionTracker.load(spark, path).__dict__), update, lambda path: tracker.save(spark, path))


def learn(stream: DataFrame, model: IncrementalBooster, state_path: str, y: str = "y", **options) -> DataStreamWriter:
    """A writer that calls partial_fit on each micro-batch; ``model`` takes over a state found in ``state_path``.

    A callable metric is no part of the state: that of ``model`` stays.
    """
    spark = stream.sparkSession

    def restore(path: str) -> None:
        metric = model.params["scoring_metric"]
        model.__dict__.update(IncrementalBooster.load(spark, path).__dict__)
        if callable(metric):
            model.params["scoring_metric"] = metric

    return _writer(stream, state_path, restore, lambda batch, number: model.partial_fit(batch, y, **options), lambda path: model.save(spark, path))
