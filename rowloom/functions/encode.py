"""Length-prefixed encoding of rows, stable identifiers of differences, and the order of encoded rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def field(c: Column) -> Column:
    """Four bytes of length, big end first, then the UTF-8 bytes."""
    c = text(c)
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), F.encode(c, "UTF-8"))


def row(cols: Sequence[Column]) -> Column:
    return F.concat(*[field(c) for c in cols]) if cols else F.unhex(F.lit(""))


def decode(data: Column, fields: int) -> Column:
    """array<string>: the fields of an encoded row, the reverse of ``row``; null if the bytes are cut short or go on."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("int")

    def step(acc: Column, _: Column) -> Column:
        n = number(acc["at"])
        one = F.decode(F.substring(data, acc["at"] + 4, n), "UTF-8")
        fits = acc["at"] + 3 + n <= F.octet_length(data)
        return F.struct((acc["at"] + 4 + n).alias("at"), F.when(fits, F.array_append(acc["out"], one)).alias("out"))

    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = lambda acc: F.when(acc["at"] == F.octet_length(data) + 1, acc["out"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(fields)), start, step, done)


def difference_id(kind: Column, key: Column, old: Column | None, new: Column | None) -> Column:
    """First 32 hex digits of SHA-256 over kind, key and the row or rows of a difference; ``old`` and ``new`` are null for
    a side that the difference lacks."""
    empty, zero = F.unhex(F.lit("")), F.unhex(F.lit("00"))
    part = lambda mark, r: F.when(r.isNotNull(), F.concat(F.unhex(F.lit(mark)), key, zero, r)).otherwise(empty)
    pieces = [F.encode(kind, "UTF-8")] + [part(m, r) for m, r in (("00", old), ("01", new)) if r is not None]
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 32)


def order(cols: Sequence[Column], descending: bool = False) -> list[Column]:
    """Sort keys of the encoded form: shorter fields first, then by bytes."""
    keys = [k for c in cols for k in (F.octet_length(text(c)), text(c))]
    return [k.desc() if descending else k.asc() for k in keys]
