"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import store


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a long, b long). Returns (id, component), one row per id of an edge; component is the smallest id reachable.

    Each step is a map-side combined minimum per node and one join; a node with very many edges is a skewed join
    key that adaptive execution splits. Nothing but two totals per round reaches the driver.
    An empty edge list gives an empty result; loops and repeated edges are harmless.
    """
    cur = store.keep(_tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "cc")
    mark = _mark(cur)
    while mark[0]:
        big = store.keep(_star(cur, large=True), "cc")
        new = store.keep(_star(big, large=False), "cc")
        now = _mark(new)
        store.drop(cur)
        store.drop(big)
        cur = new
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u > v").distinct()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """e: u > v. The large star hangs each node's larger neighbours on its smallest one; the small star does so with
    the node and its smaller neighbours."""
    if large:
        least = e.select(F.col("u").alias("n"), F.col("v").alias("m")).groupBy("n").agg(F.min("m").alias("m"))
        # a node's larger neighbours are those it stands beside as v; with none smaller it is its own minimum
        joined = e.join(least, e.v == least.n, "left")
        hung = joined.select("u", F.coalesce("m", "v").alias("v"))
        return _tidy(hung)
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    # v hangs on u's smallest neighbour, and so does u itself
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return _tidy(hung)


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
