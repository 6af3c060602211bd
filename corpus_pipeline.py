"""The corpus pipeline: quality, line dedup, near-duplicate documents, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes a stage's rows as
Parquet to the shared folder and reads them again as the next stage's documents.

Of the documents only the columns doc_id, text, lang, source and n_chars go through; others, whatever their names, are left
out by every stage but the last, which returns what it decides. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, linededup, mixing, quality, simhash, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(docs: DataFrame) -> DataFrame:
    return store.columns(docs, *COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts score as the labels at large, so they stay where good labels are the more common; without labels of both
    kinds all stay. Repeated rows and ties fare alike; a null doc_id is scored like any other.
    """
    return quality.keep_good(_documents(docs), _table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier near copy go out of the texts; n_chars follows.

    All rows stay, also those whose text ends up empty. A null text stays null with n_chars null; a null doc_id comes after all
    others; rows that share doc_id and text lose the same lines.
    """
    return linededup.clean(_documents(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Null and empty texts are copies of each other; equal rows count as one; rows with a null doc_id stay; rows that share the
    doc_id only are documents of their own.
    """
    return simhash.keep_one(_documents(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and items match nothing; items with a null item_id count; repeated rows fare alike.
    """
    return decontaminate.drop_contaminated(_documents(docs), _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): how often each document is taken, so that the sources meet their
    target weights.

    A null text has size 0 and is not taken; the null source is one of its own, last; repeated rows are rows of their own,
    those of one size in the order of a hash of their doc_id.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages kept on the way is deleted once it has been read for the last time."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, store.finished(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
        store.drop(last)
    return docs
