"""Watching inputs: a comparison is made again whenever a watched file or folder gains or changes files."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowloom.plans.options import UsageError

MOST_PATHS, MOST_WATCHES = 3, 16
_WATCHES = threading.BoundedSemaphore(MOST_WATCHES)


def snapshot(paths: list[str]) -> list[tuple]:
    """(path, exists, size, mtime in ns, inode) of each file; folders and more than three paths are refused."""
    if not 0 < len(paths) <= MOST_PATHS:
        raise UsageError(f"watch one to {MOST_PATHS} paths")
    out = []
    for p in paths:
        if os.path.isdir(p):
            raise UsageError(f"{p} is a folder")
        s = os.stat(p) if os.path.exists(p) else None
        out.append((p, s is not None, s.st_size if s else 0, s.st_mtime_ns if s else 0, s.st_ino if s else 0))
    return out


def wait_for_change(paths: list[str], before: list[tuple] | None = None, timeout: float = 20.0, every: float = 0.25) -> list[tuple] | None:
    """The new snapshot once any field differs from ``before``, or None when time is up. At most ``MOST_WATCHES`` wait at a time;
    another one is refused."""
    if not _WATCHES.acquire(blocking=False):
        raise UsageError(f"{MOST_WATCHES} watches are waiting already")
    try:
        before = before or snapshot(paths)
        end = time.monotonic() + timeout
        while True:
            now = snapshot(paths)
            if now != before:
                return now
            if time.monotonic() >= end:
                return None
            time.sleep(every)
    finally:
        _WATCHES.release()


def changes(stats: DataFrame) -> DataFrame:
    """``stats``: a stream of (path, size, mtime). One row each time a path's size or time differs from the last one seen."""

    def update(key: tuple, frames, state: GroupState):
        last = state.get if state.exists else None
        for f in frames:
            for size, mtime in zip(f["size"], f["mtime"].astype("int64"), strict=True):
                now = (int(size), int(mtime))
                if last != now:
                    yield pd.DataFrame({"path": [key[0]], "size": [now[0]], "first": [last is None]})
                last = now
        state.update(last)

    return stats.groupBy("path").applyInPandasWithState(update, "path string, size long, first boolean", "size long, mtime long", "append", GroupStateTimeout.NoTimeout)


def recompare(spark: SparkSession, folder: str, schema, compare: Callable[[DataFrame, int], None], checkpoint: str, format: str = "parquet", available_now: bool = False) -> StreamingQuery:
    """Call ``compare(new rows, batch)`` for every batch of files that appears in ``folder``."""
    stream = spark.readStream.format(format).schema(schema).load(folder)
    w = stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="250 milliseconds")).start()


def running_summary(rows: DataFrame, key: list[str], side: str = "side") -> DataFrame:
    """Counts of a stream of rows of both sides by key: how many keys are one-sided so far, as an updating aggregate."""
    n = lambda s: F.count(F.when(F.col(side) == s, 1)).alias(s)
    return rows.groupBy(*key).agg(n("left"), n("right"))
