"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing of the documents table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language_id, mixing, near_dup, packing
from tidemark.llm.common import drop_tables, materialize, recorded

#: A document goes if its language is undetermined or its score is below this.
LEAST_SCORE = 0.3


#: Tables that earlier stages wrote for themselves. A stage's input is written before the next one begins, so they go then.
_written: list[str] = []


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f is language.__wrapped__:
            _written.clear()  # an earlier run's result may still be read
        drop_tables(spark, _written, docs.inputFiles())
        with recorded(_written):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents; documents without a letter, or without a clear language, go.

    Null and empty texts have no letter. Repeated rows are judged alike, languages that tie go by name; an empty table
    gives no rows.
    """
    model = language_id.fit(docs.select("text", "lang"))
    numbered = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, no name clashes
    found = language_id.identify(docs.toDF(*numbered), model, numbered[docs.columns.index("text")])
    return found.where((found.lang_pred != language_id.UNDETERMINED) & (found.score >= LEAST_SCORE)).select(*numbered).toDF(*docs.columns)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays; null counts as empty, a null id goes last."""
    return exact_dedup.keep_first(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by links of similarity 0.8 or more (five-word shingles) the row with the smallest doc_id stays.

    Texts without a word, null ones too, are copies of each other.
    """
    return near_dup.keep_one(docs)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a row for each time a document is taken, whole texts.

    The document at which a source's words end stays whole. Null and empty texts are never taken; a null source is one.
    """
    return mixing.mixed_documents(docs, whole=True)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place in a length bucket and batch; nulls, ties and repeated rows as in ``packing.pack``."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: The stages rest on fitted models and hash orders, which SQL can't express; tests/llm/test_pipeline.py compares every
#: stage's rows, and run()'s, with a plain Python version of the five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "_"))
    return docs
