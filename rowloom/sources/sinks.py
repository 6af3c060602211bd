"""Writers of comparison results."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowloom.operators.tables import TableDiff
from rowloom.plans.project import write_whole


def _codec(path: str) -> dict:
    return {"compression": "gzip"} if path.lower().endswith(".gz") else {}


def write_tsv(diff: TableDiff, path: str, header: bool = True) -> None:
    """The difference rows with quotes where needed; gzip by the suffix. Spark's commit protocol publishes all or nothing."""
    write_delimited(diff.rows(), path, "\t", header)


def write_delimited(rows: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
    text.write.options(sep=sep, quote='"', escape='"', header=header, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **_codec(path)).csv(path)


def write_jsonl(diff: TableDiff, path: str) -> None:
    diff.records().write.options(ignoreNullFields=True, **_codec(path)).json(path)


def write_summary(diff: TableDiff, path: str, top: int = 10) -> dict:
    """Counters and the ranking of changed columns as JSON; returns them."""
    out = diff.summary().first().asDict()
    if diff.options.cell_diff:
        out["column_changes"] = [r.asDict() for r in diff.column_changes().collect()]
    write_whole(path, json.dumps(out, indent=2).encode() + b"\n")
    out["line"] = "done: {left_rows:,} left, {right_rows:,} right, {equal_rows:,} equal, {diff_rows:,} difference rows".format(**out)
    out["top"] = out.get("column_changes", [])[:top]
    return out


def page(rows: DataFrame, number: int, order: list[str], size: int = 100) -> DataFrame:
    """Page ``number`` (from 0) of the rows in a given order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def changed_columns_only(diff: TableDiff) -> DataFrame:
    """The difference rows with only those data columns that changed somewhere."""
    changed = {r.name for r in diff.column_changes().collect()}
    rows = diff.rows()
    own = [c for c in rows.columns if c in ("_diff", "_side", "_changed_cols")]
    return rows.select(*own, *[F.col(f"`{c}`") for c in diff.plan.columns if c in changed or c in diff.plan.key])


def find_columns(names: list[str], text: str) -> list[str]:
    """The column names that hold ``text``, whatever its case."""
    return [n for n in names if text.lower() in n.lower()]


class Progress:
    """Rows, bytes and rates of what has passed a DataFrame, from an observation that Spark keeps while the plan runs."""

    def __init__(self, phase: str, label: str = ""):
        self.phase, self.label, self.seen, self.began = phase, label, Observation(), time.monotonic()

    def watch(self, rows: DataFrame, size: Column | None = None) -> DataFrame:
        """``rows`` unchanged, counted as they pass; ``size`` gives a row's bytes."""
        return rows.observe(self.seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).cast("long").alias("bytes"))

    def report(self) -> dict:
        """After the plan has run: rows, bytes, elapsed seconds, rows_per_second, mib_per_second."""
        got, elapsed = self.seen.get, max(time.monotonic() - self.began, 0.001)
        rates = {"rows_per_second": got["rows"] / elapsed, "mib_per_second": got["bytes"] / (1 << 20) / elapsed}
        return {"phase": self.phase, "label": self.label, "elapsed": elapsed, **got, **rates}


def search(rows: DataFrame, text: str, regex: bool = False, case: bool = False, columns: list[str] | None = None, most: int = 2000) -> DataFrame:
    """Rows with a cell that holds the text, and the number of ``hits``; at most ``most`` of them."""
    import re

    pattern = ("" if case else "(?i)") + (text if regex else re.escape(text))
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or rows.columns]
    hits = sum((F.regexp_count(c, F.lit(pattern)) for c in cells), F.lit(0))
    return rows.withColumn("hits", hits).filter("hits > 0").limit(most)
