"""Bit maps of ids that tell most rows of a large table that a join has nothing for them.

A map has ``PER_KEY`` bits for each key, so that few rows pass by chance, and at most ``MOST_BITS`` in all, as it is
broadcast; beyond that many keys there is no map, and the joins that it would have spared take all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.words import U64, mix

PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def bits_for(n: int) -> int | None:
    """Bits of a map of n keys, a power of two; None if it would be too large."""
    bits = max(LEAST_BITS, 1 << (PER_KEY * n - 1).bit_length())
    return bits if bits <= MOST_BITS else None


def places(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key.view(U64) ^ U64(0x5BF03635)) % U64(bits)).astype(np.int64)


def bit_map(keys: DataFrame, bits: int) -> np.ndarray:
    """Map of the places of ``keys`` (one long column ``key``), put together on the executors in pieces of 4 KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(b.column("key").to_numpy(), bits) + 1)], ["bit"])

    at = keys.select("key").mapInArrow(run, "bit long")
    pieces = at.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        part = np.frombuffer(bytes(r.m), np.uint8)
        at = (r.n - 1) * len(part)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def broadcast(spark: SparkSession, keys: DataFrame):
    """A broadcast map of ``keys`` (one long column ``key``), or None if there are too many."""
    bits = bits_for(keys.count())
    return spark.sparkContext.broadcast(bit_map(keys, bits)) if bits else None


def destroy(found) -> None:
    if found is not None:
        found.destroy()


def among(key: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether a key may be in the map; no key of the map is missed."""
    bit = places(key, 8 * len(found))
    return ((found[bit >> 3] >> (bit & 7)) & 1).astype(bool)


def rows_in(docs: DataFrame, found, inside: bool, column: str) -> DataFrame:
    """Rows of ``docs`` whose id in ``column`` may be (``inside``), or is not, among the keys of a broadcast map; null ids are
    not. Without a map any id may be."""
    if found is None:
        has = F.col(f"`{column}`").isNotNull()
        return docs.filter(has if inside else ~has)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(column)
            hit = among(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), found.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == inside))

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, gone: DataFrame, place: list[Column]) -> DataFrame:
    """``docs`` without the rows whose ``place`` (columns d and x, of doc_id and text) is in ``gone`` (d, x); only rows that
    the map can't clear are shuffled."""
    found = broadcast(docs.sparkSession, gone.select(F.col("d").alias("key")))
    held = rows_in(docs, found, True, "doc_id").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *place)
    return rows_in(docs, found, False, "doc_id").unionByName(held.join(gone, ["d", "x"], "left_anti").select("row.*"))
