"""Text for people: cell widths, truncation, control characters, grouped numbers, sizes and times."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, functions as F

CLUSTER = regex.compile(r"\X")


def cluster_width(c: str) -> int:
    """Terminal cells of one grapheme cluster: its widest sign, two for emoji sequences, none for marks alone."""
    if "️" in c or "‍" in c or "\U0001f1e6" <= c[0] <= "\U0001f1ff" and len(c) > 1:
        return 2
    width = 0
    for ch in c:
        if unicodedata.category(ch) in ("Mn", "Me", "Cf", "Cc"):
            continue
        width = max(width, 2 if unicodedata.east_asian_width(ch) in "WF" else 1)
    return width


def width(s: str) -> int:
    return len(s) if s.isascii() and s.isprintable() else sum(map(cluster_width, CLUSTER.findall(s)))


def truncate(s: str, most: int) -> str:
    """At most ``most`` cells, with an ellipsis of dots where it is cut; clusters stay whole."""
    if most <= 0:
        return ""
    if width(s) <= most:
        return s
    if most <= 3:
        return "." * most
    out, used = "", 0
    for c in CLUSTER.findall(s):
        if used + cluster_width(c) > most - 3:
            break
        out, used = out + c, used + cluster_width(c)
    return out + "..."


def pad(s: str, cells: int) -> str:
    s = truncate(s, cells)
    return s + " " * (cells - width(s))


def inline(s: str) -> str:
    """On one line: line feeds, returns and tabs escaped, other control characters by their number."""
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(named.get(c) or (f"\\u{ord(c):04X}" if unicodedata.category(c) == "Cc" else c) for c in s)


def width_column(c: Column) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else width(x))

    return run(c)


def truncate_column(c: Column, most: int) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else truncate(x, most))

    return run(c)


def inline_column(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else inline(x))

    return run(c)


def html_escape(c: Column) -> Column:
    """Text for a page: the five signs that HTML reserves as entities."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def grouped(c: Column) -> Column:
    return F.format_number(c, 0)


def human_bytes(c: Column) -> Column:
    """1024-based, one digit behind the point from KiB on; empty for a missing size (-1)."""
    unit = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) / 10))).cast("int")
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KiB", "MiB", "GiB", "TiB")]), unit + 1)
    scaled = F.round(c / F.pow(F.lit(1024.0), unit.cast("double")), 1)
    return F.when(c < 0, "").when(unit == 0, F.concat(c.cast("string"), F.lit(" B"))).otherwise(F.concat(scaled.cast("decimal(18,1)").cast("string"), F.lit(" "), name))


def timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
