"""Column builders that normalise values before a comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowloom.plans.options import Rules, java_pattern

#: A decimal number as the numeric rules read it: no hexadecimal, no type suffix, no digit separators.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
SPECIAL = r"^[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def lower(c: Column) -> Column:
    """Lower case letter by letter: without the final sigma, and with a plain i for the dotted capital I."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space, none at the edges."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s", "")


def normalise(c: Column, rules: Rules) -> Column:
    """Filters in their order, then white space, then case."""
    for p in rules.filters:
        c = F.regexp_replace(c, F.lit(java_pattern(p)), F.lit(""))
    if rules.whitespace == "change":
        c = collapse_space(c)
    elif rules.whitespace == "all":
        c = strip_space(c)
    return lower(c) if rules.ignore_case else c


def number(c: Column, special: bool = False) -> Column:
    """A string as a double, null where it is none; ``special`` admits infinities and NaN."""
    t = F.trim(c)
    # the cast is tried on what passes the pattern only, whatever order the optimiser picks
    plain = F.when(t.rlike(NUMBER), t).try_cast("double")
    if not special:
        return F.when(~F.isnan(plain) & (F.abs(plain) < float("inf")), plain)
    return F.coalesce(plain, F.when(t.rlike(SPECIAL), t).try_cast("double"))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Both numbers, and not further apart than the tolerance."""
    return F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))
