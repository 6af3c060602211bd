"""Rows that meet under a key, compared inside the task that holds the key, in blocks of a bounded size.

A bucket of more than ``most`` members or lookers is cut into blocks of each and laid out as the cells (i, j) of a grid, so
no task holds an unbounded group. Cells return spanning edges and counts: never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import store

#: Hot keys are broadcast up to this number, joined by shuffle beyond it.
BROADCAST_KEYS = 100_000


def grid(rows: DataFrame, sizes: DataFrame, most: int, order: str) -> DataFrame:
    """``rows``: (key, role, ...), role 0 for a bucket's members and 1 for those that only look into it;
    ``sizes``: (key, n, lookers), members and lookers of each key that may have many. Adds (i, j) and deals the rows out by
    (key, i, j), sorted.

    k blocks of members meet each other in the cells (i, j), i <= j < k, and each block of lookers in a cell (i, j), j >= k.
    """
    blocks = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / most).cast("int")
    hot = store.keep(sizes.filter((F.col("n") > most) | (F.col("lookers") > most)).select("key", blocks("n").alias("k"), blocks("lookers").alias("l")), "hot")
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left")
        b = lambda c: f"cast(pmod(xxhash64({order}), {c}) as int)"
        cells = (
            F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), "role")))
            .when(F.col("role") == 1, F.expr(f"transform(sequence(0, k - 1), x -> struct(x as i, k + {b('l')} as j, 1 as role))"))
            .otherwise(
                F.expr(
                    f"""concat(transform(sequence(0, k - 1), x -> struct(least(x, {b('k')}) as i, greatest(x, {b('k')}) as j, if(x < {b('k')}, 1, 0) as role)),
                    transform(sequence(0, l - 1), x -> struct({b('k')} as i, k + x as j, 0 as role)))"""
                )
            )
        )
        rest = [c for c in rows.columns if c not in ("role", "k", "l")]
        rows = rows.withColumn("cell", F.explode(cells)).select(*rest, "cell.role", "cell.i", "cell.j")
    else:
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Tables of whole (key, i, j) groups from a sorted stream, of about ``rows`` rows or one larger group."""
    held: list[pa.RecordBatch] = []
    last = None
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _ids(batch)
        new = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        cut = int(new[-1]) if len(new) else 0
        if held and last is not None and (ids[0] != last).any() and not cut and size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        if cut and size + cut >= rows:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, size = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            size += batch.num_rows
        last = ids[-1]
    if held:
        yield pa.Table.from_batches(held)


def _ids(t) -> np.ndarray:
    return np.stack([column(t, c).astype(np.int64) for c in ("key", "i", "j")], axis=1)


def column(t, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(name).to_numpy()


def ranges(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row the range of members it is compared with: later members of its own block, or all of the block it looks into."""
    ids, role = _ids(t), column(t, "role")
    n = len(role)
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if n else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    members = np.add.reduceat(role == 0, first) if n else first
    start, stop = first[group], (first + members)[group]
    lo = np.where(role == 0, np.arange(n) + 1, start)
    hi = np.where((role == 0) & (ids[:, 1] != ids[:, 2]), lo, stop)
    return lo, np.maximum(lo, hi)


def pairs(lo: np.ndarray, hi: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, partner), in blocks of about ``most``."""
    count = hi - lo
    total = np.r_[0, np.cumsum(count)]
    r, n = 0, len(lo)
    while r < n:
        e = max(r + 1, int(np.searchsorted(total, total[r] + most, "right")) - 1)
        c = count[r:e]
        left = np.repeat(np.arange(r, e), c)
        if len(left):
            yield left, np.arange(len(left)) - np.repeat(total[r:e] - total[r], c) + np.repeat(lo[r:e], c)
        r = e


class Forest:
    """Union-find over local rows, whole arrays at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]
