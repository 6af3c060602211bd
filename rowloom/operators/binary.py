"""Byte differences of binary pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGION = "struct<offset: long, old: binary, new: binary>"
RESULT = f"struct<equal: boolean, diff_bytes: long, old_size: long, new_size: long, truncated: boolean, regions: array<{REGION}>>"


def byte_diff(old: bytes | None, new: bytes | None, max_regions: int = 256, max_bytes: int = 32, gap: int = 16) -> dict:
    """Differing regions: differences at most ``gap`` equal bytes apart share a region until it holds ``max_bytes``; regions
    end on a difference. Bytes past the shorter side differ. Totals count every difference, stored or not."""
    a, b = np.frombuffer(old or b"", np.uint8), np.frombuffer(new or b"", np.uint8)
    n = min(len(a), len(b))
    spots = np.flatnonzero(a[:n] != b[:n])
    longest = max(len(a), len(b))
    out = {"equal": not len(spots) and len(a) == len(b), "diff_bytes": len(spots) + longest - n, "old_size": len(a), "new_size": len(b), "truncated": False, "regions": []}
    at = 0  # the next place that a region may begin
    while True:
        k = int(np.searchsorted(spots, at))
        start = int(spots[k]) if k < len(spots) else max(at, n)
        if start >= longest:
            return out
        if len(out["regions"]) == max_regions:
            out["truncated"] = True
            return out
        # the last difference that belongs to the region
        limit = start + max_bytes
        run = spots[k : int(np.searchsorted(spots, limit))] if k < len(spots) else spots[:0]
        if len(run):
            wide = np.flatnonzero(np.diff(run) > gap + 1)
            last = int(run[wide[0]] if len(wide) else run[-1])
            reach = not len(wide) and n - last <= gap + 1
        else:
            last, reach = start, True
        end = min(limit, longest) if reach and longest > n and n < limit else last + 1
        out["regions"].append({"offset": start, "old": bytes(a[start : min(end, len(a))]), "new": bytes(b[start : min(end, len(b))])})
        at = end


def diff_binary(pairs: DataFrame, old: str = "old", new: str = "new", max_regions: int = 256, max_bytes: int = 32, gap: int = 16) -> DataFrame:
    """``pairs`` without the two sides, with the fields of RESULT; a null side is empty."""
    keep = [c for c in pairs.columns if c not in (old, new)]

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([byte_diff(x, y, max_regions, max_bytes, gap) for x, y in zip(a, b, strict=True)], columns=["equal", "diff_bytes", "old_size", "new_size", "truncated", "regions"])

    return pairs.select(*keep, run(F.col(old), F.col(new)).alias("d")).select(*keep, "d.*")
