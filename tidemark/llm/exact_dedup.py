"""Exact duplicates through a log-structured merge index of digests (DataFrame functions only).

Rows come in batches. A batch is a memtable: combined and sorted by digest, it is flushed as a run, Parquet files
with the least and greatest digest of their parts. Every run has a filter, a blocked Bloom filter kept as a table
of bitmaps, dealt by block. A new batch is looked up in the earlier runs only where
their filters say that they may hold the digest. After ``fan_in`` batches compaction merges the runs into a level
that keeps for each digest the smallest identifier and the number of rows; ``fan_in`` levels are merged into one
again. Digests seen more than once are hits; the texts of hits, and of no other row, are read again and compared
byte for byte, so a clash of digests joins nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WS, drop_tables, materialize, maybe_broadcast, recorded

ROW_BYTES = 120
#: Batches of one call and runs that are merged together.
BATCHES, FAN_IN = 6, 3
#: Bits that a digest sets in its block of a filter, bits of a block (those of Spark's bitmap functions), and
#: digests meant for a block: of the digests that a filter doesn't hold, some 2 % pass.
BITS, BLOCK_BITS, PER_BLOCK = 4, 32_768, 4096


def normalised(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class Filter:
    """A blocked Bloom filter as a table (block, bitmap): as many blocks as the rows need, no limit to their number."""

    def __init__(self, rows: DataFrame, n: int) -> None:
        self.blocks = max(1, -(-n // PER_BLOCK))
        marked = rows.select(self._block().alias("block"), F.explode(F.array(*[self._bit(i) for i in range(BITS)])).alias("bit"))
        # A bitmap is combined before the shuffle; a digest that fills a third of the rows sets the same bits again.
        self.bitmaps = materialize(marked.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "filter")

    def _block(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), "digest"), F.lit(self.blocks))

    @staticmethod
    def _bit(i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(i), "digest"), F.lit(BLOCK_BITS))

    def maybe(self, rows: DataFrame) -> DataFrame:
        """The rows (digest, ...) whose digest may be in the filter."""
        byte = lambda bit: F.conv(F.hex(F.substring("bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = [F.getbit(byte(b), (b % 8).cast("int")) == 1 for b in map(self._bit, range(BITS))]
        held = maybe_broadcast(self.bitmaps.withColumnRenamed("block", "_block"), self.blocks, BLOCK_BITS // 8)
        return rows.join(held, self._block() == F.col("_block")).where(reduce(Column.__and__, hit)).drop("_block", "bitmap")


class DigestIndex:
    """A log-structured merge index digest -> (smallest identifier, rows).

    ``add`` flushes a batch as a sorted run with a filter, and says which of its digests were there before or came
    twice; ``fan_in`` runs of a level are merged into one of the next. Tables that a merge makes needless are deleted.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[tuple[DataFrame, Filter, list[str]]]] = [[]]

    @staticmethod
    def _merged(parts: list[DataFrame]) -> DataFrame:
        """One row a digest; partial sums go before the shuffle, so no digest is hot."""
        return reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))

    def runs(self) -> list[tuple[DataFrame, Filter, list[str]]]:
        return [run for level in self.levels for run in level]

    def add(self, rows: DataFrame) -> DataFrame:
        """Flush rows (digest, doc_id, uid); returns the digests that earlier rows or two of these have: the hits."""
        paths: list[str] = []
        with recorded(paths):
            first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
            flushed = rows.select("digest", first.alias("first"), F.lit(1).cast("long").alias("rows")).groupBy("digest").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
            run = materialize(flushed.sortWithinPartitions("digest"), "run")
            n = run.count()
            found = [run.where("rows > 1").select("digest")]
            for earlier, bloom, _ in self.runs():
                asked = bloom.maybe(run.select("digest"))
                found.append(asked.join(earlier.select(F.col("digest").alias("_d")), F.col("digest") == F.col("_d"), "left_semi"))
            hits = materialize(reduce(DataFrame.union, found).distinct(), "hits")
            kept = list(paths[:1])
            with recorded(kept):
                self.levels[0].append((run, Filter(run, n), kept))
        self._compact()
        return hits

    def _compact(self) -> None:
        """Merge the runs of every level that has ``fan_in`` of them."""
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fan_in:
                self._merge(k, self.levels[k])
                self.levels[k] = []
            k += 1

    def _merge(self, k: int, runs: list) -> None:
        if k + 1 == len(self.levels):
            self.levels.append([])
        paths: list[str] = []
        with recorded(paths):
            level = materialize(self._merged([r for r, _, _ in runs]).sortWithinPartitions("digest"), "level")
            self.levels[k + 1].append((level, Filter(level, level.count()), paths))
        for _, _, old in runs:
            drop_tables(self.spark, old, [])

    def compact(self) -> DataFrame:
        """All runs as one: digest, first (none, doc_id, uid), rows."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [[], []]
            self._merge(0, runs)
        return self.runs()[0][0]


def classes(rows: DataFrame, text: Column, digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> tuple[DataFrame, DataFrame, int]:
    """The rows' digests (uid, doc_id, digest), the classes of equal texts with two rows or more, and their number.

    rows: doc_id, uid (unique) and what ``text`` reads. Texts are read twice, but uid only once, unless two texts share
    a digest; then the rows have to lie in a written table. A class has digest, clash (null, or where one digest has several texts the text itself), first (of its rows, the one with
    the smallest doc_id, nulls last, then the smallest uid) and rows.
    """
    spark = rows.sparkSession
    keys = materialize(rows.select("uid", "doc_id", digest(normalised(text)).alias("digest"), F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int").alias("batch")), "keys", "batch")
    index = DigestIndex(spark)
    hits = [index.add(keys.where(F.col("batch") == b).drop("batch")) for b in range(batches)]
    seen = reduce(DataFrame.union, hits).distinct().select(F.col("digest").alias("hit"))
    level = index.compact()
    owners = materialize(level.join(seen, F.col("digest") == F.col("hit"), "left_semi"), "owners")
    n = owners.count()
    # Byte verification: the texts of hits only are compared, as grouping keys, combined before the shuffle.
    asked = maybe_broadcast(owners.select(F.col("digest").alias("hit")), n, ROW_BYTES)
    again = rows.select("uid", "doc_id", normalised(text).alias("norm")).withColumn("digest", digest(F.col("norm"))).join(asked, F.col("digest") == F.col("hit"), "left_semi")
    texts = again.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    verified = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")), "verified")
    if verified.join(owners.select(F.col("digest").alias("_d"), "rows"), F.col("digest") == F.col("_d")).where("n <> rows").limit(1).count():
        raise RuntimeError("the input changed between two reads")
    split = verified.where("texts > 1").select(F.col("digest").alias("hit"))
    sole = owners.join(verified.where("texts = 1").select(F.col("digest").alias("_d")), F.col("digest") == F.col("_d"), "left_semi").select("digest", F.lit(None).cast("string").alias("clash"), "first", "rows")
    if split.limit(1).count():  # one digest with several texts: each text is a class of its own
        first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
        apart = again.join(split.withColumnRenamed("hit", "_h"), F.col("digest") == F.col("_h"), "left_semi").groupBy("digest", F.col("norm").alias("clash")).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"))
        sole = sole.unionByName(apart)
    return keys.drop("batch"), materialize(sole, "classes"), n


def _with_class(rows: DataFrame, found: DataFrame, n: int, norm: Column | None) -> DataFrame:
    """``rows`` (digest, ...) with c_first and c_rows of their class, null if the text is the only one of its kind."""
    same = F.col("digest") == F.col("c_digest")
    if norm is not None:
        same = same & (F.col("c_clash").isNull() | (F.col("c_clash") == norm))
    named = found.select(F.col("digest").alias("c_digest"), F.col("clash").alias("c_clash"), F.col("first").alias("c_first"), F.col("rows").alias("c_rows"))
    return rows.join(maybe_broadcast(named, n, ROW_BYTES), same, "left")


def _clashes(found: DataFrame) -> bool:
    return bool(found.where("clash IS NOT NULL").limit(1).count())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; a null id sorts after all others; of repeated rows (same id and text) one is
    kept; an empty table gives an empty result; further columns are ignored, whatever their names. ``digest`` can be
    replaced by a weaker one in tests; text_sha256 is then that one, unless texts clash.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("uid"))
    keys, found, n = classes(base, F.col("text"), digest)
    clashes = _clashes(found)
    if clashes:
        base = materialize(base, "clashing")
        _, found, n = classes(base, F.col("text"), digest)
        keys = base.select("uid", "doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    out = _with_class(keys, found, n, F.col("norm") if clashes else None)
    mine = F.col("c_rows").isNull()
    return out.select(
        "doc_id",
        F.when(mine, F.col("doc_id")).otherwise(F.col("c_first.doc_id")).alias("keep_id"),
        F.coalesce("c_rows", F.lit(1).cast("long")).alias("group_size"),
        (mine | (F.col("uid") == F.col("c_first.uid"))).alias("kept"),
        (sha256(F.col("norm")) if clashes else F.col("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the smallest doc_id.

    Nulls, ties and repeated rows as in ``exact_dedup``; other columns pass unchanged, whatever their names.
    """
    text = F.col("row.text")
    # The caller's columns lie in a struct, so their names clash with nothing.
    staged = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid")), "staged")
    _, found, n = classes(staged.select(F.col("row.doc_id").alias("doc_id"), "row", "uid"), text)
    clashes = _clashes(found)
    out = _with_class(staged.withColumn("digest", sha256(normalised(text))), found, n, normalised(text) if clashes else None)
    return out.where("c_rows IS NULL OR uid = c_first.uid").select("row.*")
