"""Delimited text as tables of strings: format resolution, dialects, headers, inspection."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.plans.options import CompareError, TableOptions, UsageError, plan_tables

DELIMITERS = {"comma": ",", "tab": "\t", "\\t": "\t", "pipe": "|"}


def delimiter(text: str) -> str:
    """A named delimiter or one ASCII character."""
    d = DELIMITERS.get(text.lower(), text)
    if len(d) != 1 or ord(d) > 127 or d in '\r\n\0"':
        raise UsageError(f"not a delimiter: {text!r}")
    return d


@dataclass(frozen=True)
class Input:
    """How a file is read. ``parser``: rfc4180 (quotes, multi-line fields) or simple (every delimiter counts, splittable)."""

    path: str
    delimiter: str
    parser: str
    trim: bool = False
    has_header: bool = True


def _stem(path: str) -> str:
    low = path.lower()
    return low[:-3] if low.endswith(".gz") else low


def resolve(spark: SparkSession, path: str, format: str = "auto", delim: str = "", parser: str = "auto", trim: bool = False, has_header: bool = True) -> Input:
    """Delimiter and parser by option, suffix, or the first line: more tabs than commas outside quotes mean TSV."""
    if path == "-":
        raise UsageError("a table can't come from standard input")
    if format not in ("auto", "csv", "tsv"):
        raise UsageError(f"no format {format!r}")
    if parser not in ("auto", "rfc4180", "simple"):
        raise UsageError(f"no parser {parser!r}")
    ext = os.path.splitext(_stem(path))[1]
    if delim:
        d = delimiter(delim)
    elif format != "auto":
        d = "\t" if format == "tsv" else ","
    elif ext in (".tsv", ".tab"):
        d = "\t"
    elif ext == ".csv":
        d = ","
    else:
        d = sniff(spark, path)
    return Input(path, d, ("simple" if d == "\t" else "rfc4180") if parser == "auto" else parser, trim, has_header)


def sniff(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    outside = "".join((first[0][0] if first else "").split('"')[0::2])
    return "\t" if outside.count("\t") > outside.count(",") else ","


def _reader(spark: SparkSession, i: Input):
    r = spark.read.option("sep", i.delimiter).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", i.trim).option("enforceSchema", True)
    if i.parser == "simple":
        return r.option("quote", "").option("nullValue", "\0").option("emptyValue", "")
    return r.option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "\0").option("emptyValue", "")


def header(spark: SparkSession, i: Input) -> list[str]:
    """Column names: the first record, or column_0 and so on."""
    first = _reader(spark, i).option("header", False).csv(i.path).limit(1).collect()
    if not first:
        raise CompareError(f"{i.path} is empty")
    cells = ["" if c is None else c for c in first[0]]
    cells[0] = cells[0].removeprefix("﻿")
    return cells if i.has_header else [f"column_{k}" for k in range(len(cells))]


def read_table(spark: SparkSession, i: Input) -> DataFrame:
    """All cells as strings, empty ones as empty strings; a record of another width fails the query."""
    names = header(spark, i)
    inner = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(len(names))])
    df = _reader(spark, i).option("header", i.has_header).schema(inner).csv(i.path)
    cells = [F.coalesce(f"_{k}", F.lit("")) for k in range(len(names))]
    if i.parser == "rfc4180":
        cells = [F.replace(c, F.lit("\r\n"), F.lit("\n")) for c in cells]
    if not i.has_header and cells:
        cells[0] = F.regexp_replace(cells[0], "^\\x{FEFF}", "")
    return df.select(*[c.alias(f"_{k}") for k, c in enumerate(cells)]).toDF(*names)


def ragged(spark: SparkSession, i: Input, most: int = 10) -> DataFrame:
    """(file, line, cells): the first ``most`` records of a simple file whose width is not the header's; line counts a file's
    lines that are not blank from 0, a split's place in its file by its blocks."""
    width = len(header(spark, i))
    rows = spark.read.text(i.path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    cells = F.length("value") - F.length(F.replace("value", F.lit(i.delimiter), F.lit(""))) + 1
    bad = rows.filter((F.col("value") != "") & (cells != width)).select("file", "start", "id", cells.alias("cells"))
    bad = bad.orderBy("file", "start", "id").limit(most)
    first = rows.groupBy("file").agg(F.min("id").alias("first"))
    # inside a split the numbers go up one by one, so a file of one split is exact
    return bad.join(first, "file").select("file", (F.col("id") - F.col("first")).alias("line"), "cells").orderBy("file", "line")


def inspect(spark: SparkSession, left: Input, right: Input, options: TableOptions | None = None) -> dict:
    """Headers, key and whether columns are reordered, from the first records alone."""
    a, b = header(spark, left), header(spark, right)
    plan = plan_tables(a, b, options or TableOptions(has_header=left.has_header))
    return {"left": a, "right": b, "columns": plan.columns, "key": plan.key, "reordered": a != b, "left_delimiter": left.delimiter, "right_delimiter": right.delimiter}
