"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import TOKEN, cells_for, materialize, running_total

#: Groups of over 1/SINGLE of the table (at most SINGLE a dimension) are placed one by one, all others in PARCELS
#: parcels by a hash of the text. Both only bound what reaches the driver; neither splits a group.
SINGLE, PARCELS = 1024, 4096


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each parcel. loads: (parcels, dimensions), every dimension summing to 1 (or 0).

    Largest first, each parcel goes where its dot product with the residual capacity is highest, among shards
    that hold it in every dimension if there are any; ties go to the lower shard.
    """
    residual = np.full((shards, loads.shape[1]), 1.0 / shards)
    to = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -loads.sum(axis=1), -loads.max(axis=1))):
        score = residual @ loads[i]
        fits = (residual >= loads[i] - 1e-12).all(axis=1)
        to[i] = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(score))
        residual[to[i]] -= loads[i]
    return to


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Size is the UTF-8 bytes of the text plus one (null text: none, and one group with the empty text). Equal
    texts form a group, and a group stays in one shard. The one exception at any size: a group that alone is more
    than a shard's fair share (1 / shards of all bytes, tokens or rows) fits no shard and is dealt, by a hash of
    the row, into as few equal parts as fit. Slots number a shard's rows without gaps. The law is ``bytes``: the
    shards' sizes come out near equal, as far as whole groups allow; grown_shard is null. Null ids and repeated
    rows take slots of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(TOKEN)).cast("long")
    slim = materialize(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), tokens.alias("tokens"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("_uid")), "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = slim.agg(*sums).first()
    if not total["rows"]:
        return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    whole = [max(1, total[k]) for k in ("bytes", "tokens", "rows")]
    share = F.greatest(*[F.col(k) / F.lit(float(n)) for k, n in zip(("bytes", "tokens", "rows"), whole)])
    # At most SINGLE groups a dimension have so large a share; the others' sums stay in the cluster.
    single = slim.groupBy("digest").agg(*sums).withColumn("share", share).where(F.col("share") > 1.0 / SINGLE).select("digest", "share").collect()
    table = [(r["digest"], max(1, math.ceil(r["share"] * shards - 1e-9))) for r in sorted(single, key=lambda r: r["digest"])]
    heavy = spark.createDataFrame(table, "heavy string, parts int")
    light = F.pmod(F.xxhash64("digest"), F.lit(PARCELS)).cast("string")
    # Rows without an id, or with the same, are told apart by their number in the written table.
    part = F.pmod(F.xxhash64("doc_id", "_uid"), F.col("parts")).cast("string")
    parcel = F.when(F.col("heavy").isNull(), light).otherwise(F.concat_ws(":", "digest", part))
    dealt = slim.join(F.broadcast(heavy), F.col("digest") == F.col("heavy"), "left").withColumn("parcel", parcel)
    parcels = sorted(dealt.groupBy("parcel").agg(*sums).collect(), key=lambda r: r["parcel"])
    to = place(np.array([[r["bytes"] / whole[0], r["tokens"] / whole[1], r["rows"] / whole[2]] for r in parcels]), shards)
    plan = spark.createDataFrame([(r["parcel"], int(s)) for r, s in zip(parcels, to)], "_parcel string, shard int")
    out = dealt.join(F.broadcast(plan), F.col("parcel") == F.col("_parcel")).select("doc_id", "size", "text_crc32", "shard", "_uid", F.coalesce("doc_id", "_uid").alias("_order"))
    numbered = running_total(out, ["shard"], "_order", "_uid", cells_for(total["rows"]), None, "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
