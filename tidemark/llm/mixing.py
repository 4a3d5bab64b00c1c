"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import TOKEN, cells_for, materialize, running_total

#: Fractional part of the golden ratio: its multiples are spread evenly over [0, 1).
GOLDEN = (math.sqrt(5) - 1) / 2
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Slots of the schedule, and one more a source at most: a bound on its length whatever the input; a block has total / SLOTS tokens.
SLOTS = 1 << 17


def water_level(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Targets that share the total by weight, none above ``most`` times its size; the excess is shared again by weight."""
    total, targets, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while free:
        share = total / sum(weights[i] for i in free)
        full = [i for i in free if share * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = share * weights[i]
            return targets
        for i in full:
            targets[i] = float(most * sizes[i])
            total -= targets[i]
        free = [i for i in free if i not in set(full)]
    return targets


def schedule(spark, blocks: list[int]) -> DataFrame:
    """(slot, source index, rank): each source has as many slots as ``blocks`` says; rank counts them.

    Slots in the order of frac((i + 1/2) golden) go to the sources one after the other, so slot i takes the source
    whose cumulative share holds that fraction, with edges that give every source its number exactly.
    """
    slots = sum(blocks)

    def pick(batches):
        source_no = np.empty(slots, dtype="int64")
        source_no[np.argsort(np.modf((np.arange(slots) + 0.5) * GOLDEN)[0], kind="stable")] = np.repeat(np.arange(len(blocks)), blocks)
        for b in batches:
            yield pd.DataFrame({"slot": b["slot"], "source_no": source_no[b["slot"].to_numpy(dtype="int64")]})

    if not slots:
        return spark.createDataFrame([], "slot long, source_no long, rank long")
    picked = spark.range(slots).withColumnRenamed("id", "slot").mapInPandas(pick, "slot long, source_no long")
    # At most SLOTS rows and one a source, so ranking a source's slots in one task is bounded.
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy("source_no").orderBy("slot")).cast("long") - 1)


def mix(docs: DataFrame, slots: int = SLOTS, most: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame, int]:
    """Which words of each document the mix takes, the documents with their _uid and size, and their number.

    The first has _u (the _uid), source_size, target, copies (whole passes taken), cut (words of one more,
    partial pass) and places: for each pass the parts (slot, first word, words) of the slots that take it, in slot
    order. A source's documents are laid in hash order on a line of tokens,
    which is cut into blocks and repeats up to ``most`` times; block r of the line goes to the source's slot
    of rank r. The last block ends at the target, rounded to a word, so every source gives just that. Null and empty
    texts have size 0 and are never taken. Null source is a source, sorted last.
    The number of distinct sources is taken to fit the driver (one row each).
    """
    spark = docs.sparkSession
    # The caller's columns lie in a struct, so their names clash with nothing.
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_uid"))
    sized = rows.withColumn("size", F.regexp_count(F.coalesce("row.text", F.lit("")), F.lit(TOKEN)).cast("long"))
    staged = materialize(sized, "mix")
    slim = staged.select("_uid", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in per_source]
    targets = water_level(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], most)
    total, rows = sum(sizes), sum(r["rows"] for r in per_source)
    block = max(1, -(-total // slots))
    words = [round(t) for t in targets]
    table = spark.createDataFrame([(i, r["source"], int(r["n"]), float(t), w) for i, (r, t, w) in enumerate(zip(per_source, targets, words))], "source_no long, _source string, source_size long, target double, _end long")
    plan = schedule(spark, [-(-w // block) for w in words])
    placed = slim.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    line = running_total(placed, ["source_no"], "doc_id", "_uid", cells_for(rows), "size", "start")
    # Only blocks up to the target are listed: about as many rows as the mix takes.
    end = F.least(F.col("at") + F.col("size"), F.col("_end"))
    passes = line.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    pieces = (
        passes.withColumns({"first": F.floor(F.col("at") / block), "last": F.floor((end - 1) / block)})
        .where("at < _end").withColumn("rank", F.explode(F.sequence("first", "last")))
        .select("_uid", "source_no", "pass", "size", "rank", (F.greatest(F.col("at"), F.col("rank") * block) - F.col("at")).alias("first_word"), (F.least(end, (F.col("rank") + 1) * block) - F.greatest(F.col("at"), F.col("rank") * block)).alias("words"))
    )
    got = pieces.join(plan, ["source_no", "rank"]).groupBy("_uid", "pass", "size").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("slot", "first_word", "words"))).alias("parts"))
    per_doc = got.groupBy("_uid").agg(F.sum((F.col("words") == F.col("size")).cast("int")).alias("copies"), F.sum(F.when(F.col("words") < F.col("size"), F.col("words"))).alias("cut"), F.sort_array(F.collect_list(F.struct("pass", "parts"))).alias("places"))
    taken = line.join(per_doc, "_uid", "left").select("_uid", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("int").alias("copies"), F.coalesce("cut", F.lit(0)).alias("cut"), "places")
    return taken.withColumnRenamed("_uid", "_u"), staged, rows


def mix_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Nulls as in ``mix``; repeated rows are documents of their own, documents of one hash go by their row; other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    taken, staged, _ = mix(docs.select("doc_id", "text", "source"))
    slim = staged.select("_uid", F.col("row.doc_id").alias("doc_id"), "size")
    return slim.join(taken, F.col("_uid") == F.col("_u")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("cut")).alias("taken"))


def mixed_documents(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The mix as documents, in the order of the slots in which they begin: a row for each pass.

    The document at which a source's words end has its first words only, or all of them if ``whole``. Nulls, ties and
    repeated rows as in ``mix_counts``; other columns pass unchanged, whatever their names.
    """
    taken, staged, _ = mix(docs)
    columns = docs.columns
    wanted = taken.where("copies > 0 OR cut > 0").select("_u", "copies", "cut", F.transform("places", lambda p: p["parts"][0]["slot"]).alias("slots"))
    # A merge at every size: what is small in a small table is not in a large one, and the work should grow alike.
    joined = staged.join(wanted.hint("merge"), F.col("_uid") == F.col("_u"))
    each = joined.select("*", F.posexplode("slots").alias("_pass", "_slot")).orderBy("_slot", "_pass", "_uid")
    words = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(f"({TOKEN})"), F.lit(1)), F.lit(1), F.col("cut").cast("int")), " ")
    text = F.col("row.text") if whole else F.when(F.col("_pass") >= F.col("copies"), words).otherwise(F.col("row.text"))
    changed = {} if whole else {"text": text}
    if "n_chars" in columns and not whole:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return each.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
