"""Comparison of file trees given as tables (path, size, mtime, content)."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.paths import PathFilter
from rowloom.plans.options import CompareError, UsageError

METHODS = ("contents", "hash", "quick", "date", "size")
STATUSES = ("added", "removed", "changed", "same")
MAX_ENTRIES = 2_000_000


def _plain(path: Column, content: Column) -> Column:
    """Bytes as they are compared: gzip files by what they hold."""

    @F.pandas_udf("binary")
    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([_unpacked(p, c) for p, c in zip(paths, contents, strict=True)])

    return run(path, content)


def _unpacked(path: str, content: bytes | None) -> bytes | None:
    if content is not None and path.lower().endswith(".gz"):
        try:
            return gzip.decompress(content)
        except (OSError, EOFError, zlib.error):
            pass
    return content


def compare_trees(old: DataFrame, new: DataFrame, method: str = "contents", only: PathFilter | None = None, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(path, status, old_size, new_size, old_mtime, new_mtime), sizes -1 where a side lacks the file.

    Metadata meet first; contents are digested only for pairs that these leave open, and read for no other method.
    ``max_entries`` below 0 sets no limit.
    """
    if method not in METHODS:
        raise UsageError(f"method must be one of {', '.join(METHODS)}")
    if only:
        old, new = old.filter(only.column()), new.filter(only.column())
    if max_entries >= 0:
        paths = old.select("path").union(new.select("path")).distinct().limit(max_entries + 1).count()
        if paths > max_entries:
            raise CompareError(f"more than {max_entries} files")
    side = lambda d, s: d.select(F.col("path"), F.col("size").alias(f"{s}_size"), F.col("mtime").alias(f"{s}_mtime"))
    both = side(old, "old").join(side(new, "new"), "path", "full_outer")
    here, there = F.col("old_size").isNotNull(), F.col("new_size").isNotNull()
    gz = F.lower("path").endswith(".gz")
    same_size, same_time = F.col("old_size") == F.col("new_size"), F.col("old_mtime") == F.col("new_mtime")
    if method in ("size", "date"):
        known: Column = same_size if method == "size" else same_time
    elif method == "quick":
        known = F.when(same_size & same_time, True).when(~same_size & ~gz, False)
    else:
        known = F.when(~same_size & ~gz, False)
    both = both.withColumn("known", F.when(here & there, known))
    if method in ("size", "date"):
        same = F.col("known")
    else:
        open_ = both.filter(here & there & F.col("known").isNull()).select("path")
        digest = lambda d, s: d.join(open_, "path", "left_semi").select("path", F.sha2(F.when(gz, _plain(F.col("path"), F.col("content"))).otherwise(F.col("content")), 256).alias(f"{s}_digest"))
        read = digest(old, "old").join(digest(new, "new"), "path").select("path", (F.col("old_digest") == F.col("new_digest")).alias("equal"))
        both = both.join(read, "path", "left")
        same = F.coalesce("known", "equal")
    status = F.when(~here, "added").when(~there, "removed").when(same, "same").otherwise("changed")
    return both.select("path", status.alias("status"), F.coalesce("old_size", F.lit(-1)).cast("long").alias("old_size"), F.coalesce("new_size", F.lit(-1)).cast("long").alias("new_size"), "old_mtime", "new_mtime")


def select_entries(result: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    """Rows of a status (``different``: any but same) whose path holds ``text``, whatever its case; in path order."""
    if status not in ("all", "different", *STATUSES):
        raise UsageError(f"no status {status!r}")
    if status == "different":
        result = result.filter("status <> 'same'")
    elif status != "all":
        result = result.filter(F.col("status") == status)
    if text:
        result = result.filter(F.lower("path").contains(text.lower()))
    return result.orderBy("path")


def counts(result: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return result.agg(*[n(s) for s in STATUSES])


def rollup(result: DataFrame, path: str = "path") -> DataFrame:
    """(folder, total and a count per status) at every folder above a file; the root is the empty folder."""
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = result.select(F.explode(folders).alias("folder"), "status")
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return each.groupBy("folder").agg(F.count("*").alias("total"), *[n(s) for s in STATUSES])


def preview(old: DataFrame, new: DataFrame, only: PathFilter | None = None, names: int = 20) -> dict:
    """What a filter selects: files on either side, in all, and the first names."""
    if only:
        old, new = old.filter(only.column()), new.filter(only.column())
    paths = old.select("path").union(new.select("path")).distinct()
    return {"old": old.count(), "new": new.count(), "union": paths.count(), "names": [r.path for r in paths.orderBy("path").limit(names).collect()]}


def entry_pairs(result: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old, new) contents of the entries in ``result``, null on a missing side: ready for a line or byte comparison."""
    return result.select("path").join(old.select("path", F.col("content").alias("old")), "path", "left").join(new.select("path", F.col("content").alias("new")), "path", "left")
