"""Three-way comparison and merge, of lines and of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import normalize
from rowloom.operators import lines as L
from rowloom.operators.tables import TableDiff
from rowloom.plans.options import TableOptions, UnresolvedError, UsageError
from rowloom.sources import scratch

#: The marks of an open conflict.
MARKERS = ("<<<<<<< LEFT", "||||||| BASE", "=======", ">>>>>>> RIGHT")
EVENT = "id: int, kind: string, base_start: long, base_len: long, base: array<string>, left: array<string>, right: array<string>"


#: By (left moved away from the base, right did): who changed; both may have changed alike.
MOVED = {(True, False): "left_only", (False, True): "right_only", (False, False): "same", (True, True): "conflict"}


def line_events(base: Sequence, left: Sequence, right: Sequence, o: L.LineOptions | None = None) -> list[dict]:
    """Events of a three-way comparison of (line, terminator) lists, each classified as left_only, right_only, same or
    conflict.

    The hunks of both sides are intervals of the base. A running maximum of their ends tells where an interval touches no
    earlier one, which begins an event; what a side holds in an event lies between the places that the event's bounds
    have moved to, by the lines that its hunks have added and removed up to there.
    """
    o = replace(o or L.LineOptions(), max_hunks=1 << 62, moves=False)
    hunks = [(h["old_start"], h["old_start"] + h["old_len"], side, h["new_len"] - h["old_len"]) for side, other in enumerate((left, right)) for h in L.diff(list(base), list(other), o)["hunks"]]
    if not hunks:
        return []
    start, end, side, growth = np.array(sorted(hunks), np.int64).T
    first = np.flatnonzero(np.r_[True, (start[1:] >= np.maximum.accumulate(end)[:-1]) & (start[1:] != start[:-1])])
    lo, hi = start[first], np.maximum.reduceat(end, first)
    text, moved, held = [t for t, _ in base], [], []
    own = [text[a:b] for a, b in zip(lo, hi, strict=True)]
    for k, other in enumerate((left, right)):
        after = np.cumsum(np.add.reduceat(np.where(side == k, growth, 0), first))
        before = np.r_[0, after[:-1]]
        held.append([[t for t, _ in other[a:b]] for a, b in zip(lo + before, hi + after, strict=True)])
        moved.append(np.maximum.reduceat(side == k, first))
    out = []
    for n in range(len(first)):
        sides = [h[n] for h in held]
        alone = moved[0][n] != moved[1][n]
        away = tuple(bool(moved[k][n] and (alone or sides[k] != own[n])) for k in (0, 1))
        kind = "same" if all(away) and sides[0] == sides[1] else MOVED[away]
        out.append({"id": n, "kind": kind, "base_start": int(lo[n]), "base_len": int(hi[n] - lo[n]), "base": own[n], "left": sides[0], "right": sides[1]})
    return out


def merge_events(base: list[str], events: Sequence[dict], choices: dict[int, str] | None = None, allow_unresolved: bool = False) -> tuple[list[str], int]:
    """Merged lines and the number of open conflicts, which are marked where that is allowed."""
    out, at, open_ = [], 0, 0
    for e in events:
        out += base[at : e["base_start"]]
        at = e["base_start"] + e["base_len"]
        if e["kind"] == "conflict":
            pick = (choices or {}).get(e["id"])
            if pick in ("left", "right", "base"):
                out += e[pick]
                continue
            open_ += 1
            for mark, part in zip(MARKERS, (e["left"], e["base"], e["right"], []), strict=True):
                out += [mark, *part]
        else:
            out += e["right"] if e["kind"] == "right_only" else e["left"]
    if open_ and not allow_unresolved:
        raise UnresolvedError(f"{open_} conflicts without a choice")
    return out + base[at:], open_


def compare_lines(triples: DataFrame, options: L.LineOptions | None = None, base: str = "base", left: str = "left", right: str = "right") -> DataFrame:
    """``triples`` with ``events`` and a count per kind; null sides are empty documents."""
    keep = [c for c in triples.columns if c not in (base, left, right)]

    @F.pandas_udf(f"array<struct<{EVENT}>>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([line_events(*map(L.split_lines, x), options) for x in zip(a, b, c, strict=True)])

    out = triples.select(*keep, run(F.col(base), F.col(left), F.col(right)).alias("events"))
    count = lambda k: F.size(F.filter("events", lambda e: e["kind"] == k)).alias({"conflict": "conflicts"}.get(k, k))
    return out.select(*keep, "events", *[count(k) for k in ("conflict", "left_only", "right_only", "same")])


def merge_lines(triples: DataFrame, allow_unresolved: bool = False, base: str = "base", left: str = "left", right: str = "right", choices: str | None = None) -> DataFrame:
    """``triples`` with ``merged`` (lines) and ``unresolved``; ``choices`` names a map<int, string> column."""
    keep = [c for c in triples.columns if c not in (base, left, right, choices)]

    @F.pandas_udf("struct<merged: array<string>, unresolved: int>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, z, pick in zip(a, b, c, d, strict=True):
            parts = [L.split_lines(t) for t in (x, y, z)]
            rows.append(merge_events([t for t, _ in parts[0]], line_events(*parts), dict(pick) if pick is not None else {}, allow_unresolved))
        return pd.DataFrame(rows, columns=["merged", "unresolved"])

    pick = F.col(choices) if choices else F.lit(None).cast("map<int, string>")
    return triples.select(*keep, run(F.col(base), F.col(left), F.col(right), pick).alias("m")).select(*keep, "m.*")


class TableMerge:
    """Three-way comparison of keyed tables (text columns): the differences of either side to the base, by key.

    Events: left_only, right_only, same (both sides end in the same rows), merged (both change, but different base rows)
    and conflict. All is told from the number of copies of each distinct row: those in the base, and those that either side
    removes or adds. Only the keys that a side changed are brought together. Base rows keep their order, that of the column
    ``position`` (of ``base`` alone, and not compared) or, without one, the order in which ``base`` is read, once.
    """

    def __init__(self, base: DataFrame, left: DataFrame, right: DataFrame, options: TableOptions, position: str | None = None):
        if not (options.keys or options.exclude_keys):
            raise UsageError("a three-way comparison needs an explicit key")
        self.options = replace(options, cell_diff=False)
        self.position, self.source = position, base
        self.columns = [c for c in base.columns if c != position]
        self.base = self._text(base)
        self.diffs = {name: TableDiff(self.base, self._text(side), self.options) for name, side in (("left", left), ("right", right))}
        self.plan = self.diffs["left"].plan

    def _text(self, d: DataFrame, *more: Column) -> DataFrame:
        return d.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in d.columns if c != self.position], *more)

    def _keyed(self, d: DataFrame, *more: Column) -> DataFrame:
        """(key, row, ...): the normalised key and the cells."""
        key = [F.coalesce(normalize.normalise(F.col(f"`{c}`"), self.options.rules), F.lit("")) for c in self.plan.key]
        return d.select(F.array(*key).alias("key"), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in self.columns]).alias("row"), *more)

    @cached_property
    def numbered(self) -> DataFrame:
        """(key, row, at): base rows with their position."""
        if self.position:
            return self._keyed(self._text(self.source, F.col(f"`{self.position}`").cast("long").alias("__at")), F.col("__at").alias("at"))
        at = F.monotonically_increasing_id().alias("__at")
        return self._keyed(scratch.written(self._text(self.source, at), "three-way-base"), F.col("__at").alias("at"))

    @cached_property
    def copies(self) -> DataFrame:
        """(key, row, b, gl, cl, gr, cr) of the touched keys: copies in the base, gone and come on the left, on the right."""
        names = ("b", "gl", "cl", "gr", "cr")
        one = lambda n: [F.lit(int(n == x)).cast("long").alias(x) for x in names]
        # "left" rows of a difference to the base are removed base rows, "right" rows are added
        parts = [
            self._keyed(diff.rows().filter(F.col("_side") == gone), *one(n)) for name, diff in self.diffs.items() for gone, n in (("left", f"g{name[0]}"), ("right", f"c{name[0]}"))
        ]
        touched = parts[0]
        for p in parts[1:]:
            touched = touched.unionByName(p)
        rows = touched.unionByName(self._keyed(self.base, *one("b")).join(touched.select("key").distinct(), "key", "left_semi"))
        return rows.groupBy("key", "row").agg(*[F.sum(n).alias(n) for n in names])

    def _totals(self) -> dict[str, Column]:
        """Copies that a row ends with, by side; m is the merge of both."""
        return {"l": F.expr("b - gl + cl"), "r": F.expr("b - gr + cr"), "m": F.expr("greatest(b - gl - gr + cl + cr, 0)")}

    @cached_property
    def kinds(self) -> DataFrame:
        """(key, kind, rest_l, rest_r, rest_m): rest is what a side has beside the base rows that it keeps."""
        c = self.copies
        extra = {s: F.greatest(t - F.col("b"), F.lit(0)) for s, t in self._totals().items()}
        # of what a merge adds, the left side's rows come first
        extra["mr"] = F.least(extra["m"], F.col("cr"))
        extra["ml"] = extra.pop("m") - extra["mr"]
        short_first = F.transform("row", lambda x: F.struct(F.octet_length(x), x))
        rest = lambda n: F.array_sort(F.collect_list(F.when(n > 0, F.struct(short_first.alias("o"), F.col("row").alias("row"), n.cast("int").alias("n")))))
        g = c.groupBy("key").agg(
            F.expr("max(gl + cl > 0)").alias("tl"), F.expr("max(gr + cr > 0)").alias("tr"), F.expr("min(cl = gl)").alias("back_l"), F.expr("min(cr = gr)").alias("back_r"),
            F.expr("min(cl - gl = cr - gr)").alias("alike"), F.expr("min(gl + gr <= b)").alias("apart"), *[rest(n).alias(f"rest_{s}") for s, n in extra.items()],
        )
        away_l, away_r = F.expr("tl and (not tr or not back_l)"), F.expr("tr and (not tl or not back_r)")
        kind = F.when(away_l != away_r, F.when(away_l, "left_only").otherwise("right_only")).when(~away_l | F.col("alike"), "same").when(F.col("apart"), "merged").otherwise("conflict")
        plain = lambda s: F.flatten(F.transform(f"rest_{s}", lambda x: F.array_repeat(x["row"], x["n"])))
        return g.select("key", kind.alias("kind"), plain("l").alias("rest_l"), plain("r").alias("rest_r"), F.concat(plain("ml"), plain("mr")).alias("rest_m"))

    @cached_property
    def laid(self) -> DataFrame:
        """(key, kind, base, left, right, combined): arrays of (at, n, row). A side's rows lie over the base rows: equal ones keep
        their place, others fill the places of rows that went, in order, and the rest follows the last."""
        stay = {s: F.least(F.col("b"), t).alias(f"k_{s}") for s, t in self._totals().items()}
        slots = self.numbered.join(self.copies.select("key", "row", *stay.values()), ["key", "row"])
        nth = F.row_number().over(Window.partitionBy("key", "row").orderBy("at"))
        slots = slots.withColumn("nth", nth).withColumns({f"stays_{s}": F.col("nth") <= F.col(f"k_{s}") for s in stay})
        upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        free = {f"free_{s}": F.sum((~F.col(f"stays_{s}")).cast("int")).over(upto).cast("int") for s in stay}
        slots = slots.withColumns(free | {"n": (F.count("*").over(upto) - 1).cast("int")})
        each = F.struct("at", "n", "row", *[f"{x}_{s}" for s in stay for x in ("stays", "free")])
        slots = slots.groupBy("key").agg(F.array_sort(F.collect_list(each)).alias("slots"))

        def side(s: str) -> Column:
            last, rest = F.get("slots", F.size("slots") - 1), F.col(f"rest_{s}")
            row = lambda x: F.when(x[f"stays_{s}"], x["row"]).otherwise(F.get(rest, x[f"free_{s}"] - 1))
            over = F.transform("slots", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), row(x).alias("row")))
            more = F.slice(rest, F.coalesce(last[f"free_{s}"], F.lit(0)) + 1, F.size(rest))
            more = F.transform(more, lambda x, i: F.struct(last["at"].alias("at"), (F.size("slots") + i).cast("int").alias("n"), x.alias("row")))
            return F.filter(F.concat(over, more), lambda x: x["row"].isNotNull())

        none = slots.schema["slots"].dataType.simpleString()
        e = self.kinds.join(slots, "key", "left").withColumn("slots", F.coalesce("slots", F.expr(f"cast(array() as {none})")))
        base = F.transform("slots", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["row"].alias("row")))
        e = e.select("key", "kind", base.alias("base"), side("l").alias("left"), side("r").alias("right"), side("m").alias("combined"))
        return e.withColumn("combined", F.when(F.col("kind") == "merged", F.col("combined")).otherwise(F.slice("combined", 1, 0))).select(_event_id(F.col("key")).alias("id"), "*")

    def events(self) -> DataFrame:
        """(id, kind, key, base, left, right, combined, positions): rows are arrays of text, in base row order."""
        rows = [F.transform(c, lambda x: x["row"]).alias(c) for c in ("base", "left", "right", "combined")]
        return self.laid.select("id", "kind", "key", *rows, F.transform("base", lambda x: x["at"]).alias("positions"))

    def counts(self) -> DataFrame:
        return self.kinds.groupBy("kind").agg(F.count("*").alias("events"))

    def merge(self, choices: DataFrame | None = None, allow_unresolved: bool = False) -> DataFrame:
        """The merged table, base rows in place, replacements in the place of what they replace, new keys last in key order.

        ``choices``: (id, choice) with left, right or base; an open conflict keeps the base where that is allowed.
        """
        e = self.laid
        if choices is not None:
            own = choices.filter(F.col("choice").isin("left", "right", "base")).select("id", "choice").dropDuplicates(["id"])
            e = e.join(own, "id", "left")
        else:
            e = e.withColumn("choice", F.lit(None).cast("string"))
        if not allow_unresolved and e.filter("kind = 'conflict' and choice is null").limit(1).count():
            raise UnresolvedError("conflicts without a choice")
        of = F.when(F.col("kind") == "conflict", F.coalesce("choice", F.lit("base"))).otherwise(F.col("kind"))
        takes = {"right": F.col("right"), "right_only": F.col("right"), "base": F.col("base"), "merged": F.col("combined")}
        rows = F.col("left")
        for name, c in takes.items():
            rows = F.when(of == name, c).otherwise(rows)
        changed = e.select("key", F.explode(rows).alias("x")).select("x.at", "key", "x.n", "x.row")
        same = self.numbered.join(e.select("key"), "key", "left_anti").select("at", "key", F.lit(0).alias("n"), "row")
        out = same.unionByName(changed).orderBy(F.col("at").asc_nulls_last(), F.when(F.col("at").isNull(), F.col("key")), "n")
        return out.select(*[F.col("row")[i].alias(c) for i, c in enumerate(self.columns)])


def _event_id(key: Column) -> Column:
    """The first 32 hex digits of SHA-256 over the key as a JSON array in which <, > and & are escaped."""
    text = F.concat(F.lit("["), F.array_join(F.transform(key, _escaped), ","), F.lit("]"))
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32)


def _escaped(c: Column) -> Column:
    array = F.to_json(F.array(c))
    inner = F.substring(array, F.lit(2), F.length(array) - 2)
    for code in (0x3C, 0x3E, 0x26, 0x2028, 0x2029):
        inner = F.replace(inner, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return inner


def compare_tables_three_way(base: DataFrame, left: DataFrame, right: DataFrame, options: TableOptions | None = None, position: str | None = None, **kwargs) -> TableMerge:
    return TableMerge(base, left, right, options or TableOptions(**kwargs), position)
