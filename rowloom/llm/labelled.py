"""Bounded labelled samples, and folds by crc32 of the id as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each label value in a sample, the longest text (in bytes) that a sample takes, and the bytes of all texts of a
#: label value together; scoring has none of these bounds.
PER_CLASS = 2000
MAX_BYTES = 1 << 18
MAX_TOTAL = 24 << 20


def fold(n: int, column: str = "doc_id") -> Column:
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, leave_out: int, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, max_total: int = MAX_TOTAL) -> list:
    """Rows (text, label, fold, doc_id, weight) with label 0 or 1, at most ``per_class`` ids of each: those with the smallest
    hash of their id, none of fold ``leave_out``, one text an id, up to ``max_total`` bytes in that order. An id with both
    labels counts as 1. ``weight`` makes up for the rows of a label that were left out. At most 2 * per_class ids travel to
    the documents, and 2 * max_total bytes of text to the driver."""
    one = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    one = one.filter(fold(folds) != leave_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {r.label: r.n for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pick = None
    for value in (0, 1):
        part = one.filter(F.col("label") == value).withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(per_class)
        pick = part if pick is None else pick.unionByName(part)
    got = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
        .join(F.broadcast(pick), "doc_id")
        .groupBy("label", "o", "doc_id")
        .agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text")).getField("text").alias("text"))
    )
    # at most per_class rows of a label
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = got.withColumn("upto", upto).filter(F.col("upto") <= max_total).select("text", "label", fold(folds).cast("int").alias("fold"), "doc_id").collect()
    took = {v: sum(r.label == v for r in rows) for v in (0, 1)}
    return [(r.text, r.label, r.fold, r.doc_id, total[r.label] / took[r.label]) for r in sorted(rows, key=lambda r: r.doc_id)]
