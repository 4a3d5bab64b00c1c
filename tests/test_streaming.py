"""Streams that stop and start again in a new process apply every micro-batch once."""

import numpy as np
import pandas as pd

from tidemark.operators.drift import DistributionTracker
from tidemark.operators.model import IncrementalBooster
from tidemark.streaming import foreach_batch
from tidemark.streaming.foreach_batch import learn, newest, track

NAMES = ["f0", "f1"]


def add(spark, path, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 2)) + [shift, 0]
    spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(y=x[:, 0] + 0.1 * x[:, 1])).coalesce(1).write.mode("append").parquet(str(path))


def run(stream_writer, checkpoint):
    query = stream_writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return query


def stream(spark, path):
    return spark.readStream.schema("f0 double, f1 double, y double").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_tracker_goes_on_where_it_stopped(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    add(spark, source, 0)
    seen = []
    run(track(stream(spark, source).select(*NAMES), DistributionTracker(n_bins=8), state, lambda n, r: seen.append((n, r))), tmp_path / "c")
    add(spark, source, 1, shift=3.0)
    again = DistributionTracker(n_bins=8)  # as in a new process
    run(track(stream(spark, source).select(*NAMES), again, state, lambda n, r: seen.append((n, r))), tmp_path / "c")
    assert [n for n, _ in seen] == [0, 1] and seen[0][1].is_reference and seen[1][1].drifted == ["f0"]
    assert again.n_batches_seen == 2 and newest(spark, state) == 1
    # A lost checkpoint sends all micro-batches again: none is applied again.
    third = DistributionTracker(n_bins=8)
    run(track(stream(spark, source).select(*NAMES), third, state), tmp_path / "new checkpoint")
    assert third.n_batches_seen == 2 and third.running == again.running


def test_a_failure_between_update_and_publishing_loses_nothing(spark, tmp_path, monkeypatch):
    source, state = tmp_path / "in", str(tmp_path / "state")
    for k in range(2):
        add(spark, source, k)
    whole = foreach_batch._publish

    def fails(spark, path, number, save):
        if number == 1:
            raise OSError("lost")
        whole(spark, path, number, save)

    monkeypatch.setattr(foreach_batch, "_publish", fails)
    model = IncrementalBooster(n_estimators_per_batch=3, num_leaves=4, n_bins=8)
    try:
        run(learn(stream(spark, source), model, state, features=NAMES), tmp_path / "c")
    except Exception:
        pass
    assert newest(spark, state) == 0
    monkeypatch.setattr(foreach_batch, "_publish", whole)
    again = IncrementalBooster(n_estimators_per_batch=3, num_leaves=4, n_bins=8)
    run(learn(stream(spark, source), again, state, features=NAMES), tmp_path / "c")
    assert [h["batch"] for h in again.history_] == [0, 1] and newest(spark, state) == 1 and len(again.stored_) == 2
    loaded = IncrementalBooster.load(spark, f"{state}/1")
    df = spark.read.parquet(str(source))
    assert loaded.predict(df).orderBy("f0").collect() == again.predict(df).orderBy("f0").collect()
