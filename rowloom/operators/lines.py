"""Line comparison of document pairs: bounded-window differences, synchronisation points, moves, merges, sorted mode.

A document is an array of lines; hunks come from a kernel that walks one pair of documents, in parallel over pairs.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import normalize
from rowloom.plans.options import Rules, UnresolvedError, UsageError

#: A line with its terminator, which may be missing at the end of the text only.
LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n)|([^\r\n]+)\Z")

HUNK = "struct<kind: string, old_start: long, old_len: long, new_start: long, new_len: long, move_id: int, move_peer: long>"
TOTALS = ("old_lines", "new_lines", "hunk_count", "omitted", "added", "deleted", "modified", "moved_blocks", "moved_lines")
RESULT = f"struct<{', '.join(f'{t}: long' for t in TOTALS)}, moves_skipped: boolean, hunks: array<{HUNK}>>"


@dataclass(frozen=True)
class LineOptions:
    """``window``: how far a resynchronisation looks ahead; ``max_hunks``: hunks stored (all are counted)."""

    window: int = 128
    max_hunks: int = 200
    rules: Rules = field(default_factory=Rules)
    ignore_eol: bool = False
    ignore_trailing_eol: bool = False
    sync: Sequence[tuple[int, int]] = ()
    moves: bool = False
    min_move: int = 2
    max_moves: int = 10_000


def split_lines(text: str | None) -> list[tuple[str, str]]:
    """(line, terminator) of each line; a final terminator opens no further line."""
    return [(m[1] or "", m[2]) if m[2] else (m[3], "") for m in LINE.finditer(text or "")]


def lines_column(text: Column) -> Column:
    """The lines of a text without terminators, in Catalyst."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(…, line_no, line): one row per line, counted from 0."""
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(lines_column(F.col(text))).alias("line_no", "line"))


def normaliser(rules: Rules):
    """The Python twin of ``normalize.normalise``."""
    if not rules.on:
        return None
    drop = [re.compile(p.replace("\\z", "\\Z"), re.ASCII) for p in rules.filters]
    space = re.compile("[\t-\r \x85\xa0  -     　]+")

    def run(s: str) -> str:
        for p in drop:
            s = p.sub("", s)
        if rules.whitespace == "change":
            s = space.sub(" ", s).strip(" ")
        elif rules.whitespace == "all":
            s = space.sub("", s)
        return s.replace("İ", "i").replace("Σ", "σ").lower() if rules.ignore_case else s

    return run


class _Side:
    """One document's lines as the comparison sees them."""

    def __init__(self, lines: list[tuple[str, str]], norm):
        self.text = [norm(t) for t, _ in lines] if norm else [t for t, _ in lines]
        self.eol = [e for _, e in lines]
        self.n = len(lines)
        self.at: dict[str, list[int]] = defaultdict(list)
        for i, t in enumerate(self.text):
            self.at[t].append(i)


class _Pair:
    def __init__(self, old: list[tuple[str, str]], new: list[tuple[str, str]], o: LineOptions):
        norm = normaliser(o.rules)
        self.old, self.new, self.o = _Side(old, norm), _Side(new, norm), o

    def equal(self, i: int, j: int, end_i: int, end_j: int) -> bool:
        a, b = self.old, self.new
        if a.text[i] != b.text[j]:
            return False
        x, y = a.eol[i], b.eol[j]
        if x == y or self.o.ignore_eol:
            return True
        last_i, last_j = i + 1 == end_i, j + 1 == end_j
        if (not x and last_i and not last_j) or (not y and last_j and not last_i):
            return True  # lines were appended to, or cut from, a document without a final terminator
        return self.o.ignore_trailing_eol and last_i and last_j and not (x and y)

    def _ahead(self, side: _Side, text: str, lo: int, hi: int, same) -> int | None:
        """First line from lo up to hi that equals ``text``."""
        from bisect import bisect_left

        spots = side.at.get(text, ())
        for k in range(bisect_left(spots, lo), len(spots)):
            if spots[k] >= hi:
                return None
            if same(spots[k]):
                return spots[k]
        return None

    def walk(self, i: int, end_i: int, j: int, end_j: int) -> Iterator[tuple[str, int, int, int, int]]:
        window = max(self.o.window, 1)
        while i < end_i or j < end_j:
            if i < end_i and j < end_j:
                if self.equal(i, j, end_i, end_j):
                    i, j = i + 1, j + 1
                    continue
                jj = self._ahead(self.new, self.old.text[i], j + 1, min(j + 1 + window, end_j), lambda k: self.equal(i, k, end_i, end_j))  # noqa: B023
                ii = self._ahead(self.old, self.new.text[j], i + 1, min(i + 1 + window, end_i), lambda k: self.equal(k, j, end_i, end_j))  # noqa: B023
                if jj is not None and (ii is None or jj - j <= ii - i):
                    hunk = ("insert", i, 0, j, jj - j)
                elif ii is not None:
                    hunk = ("delete", i, ii - i, j, 0)
                else:
                    hunk = ("replace", i, 1, j, 1)
            elif i < end_i:
                hunk = ("delete", i, end_i - i, j, 0)
            else:
                hunk = ("insert", i, 0, j, end_j - j)
            yield hunk
            i, j = i + hunk[2], j + hunk[4]


def check_sync(points: Sequence[tuple[int, int]], old: int, new: int) -> None:
    last = (-1, -1)
    for a, b in points:
        if not (last[0] < a < old and last[1] < b < new):
            raise UsageError(f"synchronisation point ({a}, {b}) is outside the documents or out of order")
        last = (a, b)


def diff(old: list[tuple[str, str]], new: list[tuple[str, str]], o: LineOptions | None = None) -> dict:
    """Hunks and totals of one pair of documents."""
    o = o or LineOptions()
    check_sync(o.sync, len(old), len(new))
    pair = _Pair(old, new, o)
    segments, i, j = [], 0, 0
    for a, b in o.sync:
        segments += [(i, a, j, b), (a, a + 1, b, b + 1)]
        i, j = a + 1, b + 1
    segments.append((i, len(old), j, len(new)))
    out = {"old_lines": len(old), "new_lines": len(new), "hunk_count": 0, "added": 0, "deleted": 0, "modified": 0, "moved_blocks": 0, "moved_lines": 0, "moves_skipped": False}
    hunks: list[dict] = []
    for s in segments:
        for kind, a, n, b, m in pair.walk(*s):
            out["hunk_count"] += 1
            out["added"] += m if kind == "insert" else 0
            out["deleted"] += n if kind == "delete" else 0
            out["modified"] += kind == "replace"
            if len(hunks) < o.max_hunks:
                hunks.append({"kind": kind, "old_start": a, "old_len": n, "new_start": b, "new_len": m, "move_id": 0, "move_peer": 0})
    out["omitted"] = out["hunk_count"] - len(hunks)
    out["hunks"] = hunks
    if o.moves:
        find_moves(old, new, out, o)
    return out


def find_moves(old: list[tuple[str, str]], new: list[tuple[str, str]], result: dict, o: LineOptions) -> None:
    """Pair deleted with inserted blocks of the same lines, first come first served; moved lines leave the totals."""
    if result["omitted"]:
        result["moves_skipped"] = True
        return
    block = lambda lines, a, n: tuple(t for t, _ in lines[a : a + n])
    gone = [h for h in result["hunks"] if h["kind"] == "delete" and h["old_len"] >= o.min_move][: o.max_moves]
    come = [h for h in result["hunks"] if h["kind"] == "insert" and h["new_len"] >= o.min_move][: o.max_moves]
    waiting: dict[tuple, deque] = defaultdict(deque)
    for h in gone:
        waiting[block(old, h["old_start"], h["old_len"])].append(h)
    for h in come:
        line = waiting.get(block(new, h["new_start"], h["new_len"]))
        if line:
            peer = line.popleft()
            result["moved_blocks"] += 1
            result["moved_lines"] += h["new_len"]
            result["added"] -= h["new_len"]
            result["deleted"] -= h["new_len"]
            peer["move_id"] = h["move_id"] = result["moved_blocks"]
            peer["move_peer"], h["move_peer"] = h["new_start"], peer["old_start"]


def diff_documents(pairs: DataFrame, options: LineOptions | None = None, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` with the columns of RESULT; a null side is an empty document. Rows stay where they are."""
    o = options or LineOptions()
    keep = [c for c in pairs.columns if c not in (old, new)]

    @F.pandas_udf(RESULT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [diff(split_lines(x), split_lines(y), o) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=[*TOTALS, "moves_skipped", "hunks"])

    return pairs.select(*keep, run(F.col(old), F.col(new)).alias("d")).select(*keep, "d.*")


def hunk_rows(results: DataFrame, *keys: str) -> DataFrame:
    """One row per stored hunk, numbered from 0."""
    return results.select(*keys, F.posexplode("hunks").alias("hunk", "h")).select(*keys, "hunk", "h.*")


def ignore_hunks(results: DataFrame, ignored: Column) -> DataFrame:
    """Drop the hunks whose numbers are in ``ignored`` (and the peers of moved ones) and take them out of the totals."""
    picked = F.transform("hunks", lambda h, i: F.when(F.array_contains(ignored, i.cast("int")), h["move_id"]))
    moved = F.filter(F.array_compact(picked), lambda m: m > 0)
    numbered = F.transform("hunks", lambda h, i: F.struct(h.alias("h"), (F.array_contains(ignored, i.cast("int")) | ((h["move_id"] > 0) & F.array_contains(moved, h["move_id"]))).alias("out")))
    gone = F.transform(F.filter(numbered, lambda x: x["out"]), lambda x: x["h"])
    still = F.transform(F.filter(numbered, lambda x: ~x["out"]), lambda x: x["h"])
    total = lambda test, size: F.aggregate(gone, F.lit(0).cast("long"), lambda n, h: n + F.when(test(h), size(h)).otherwise(0))
    free = lambda kind: lambda h: (h["kind"] == kind) & (h["move_id"] == 0)
    inserted_move = lambda h: (h["kind"] == "insert") & (h["move_id"] > 0)
    return results.withColumns({
        "added": F.col("added") - total(free("insert"), lambda h: h["new_len"]),
        "deleted": F.col("deleted") - total(free("delete"), lambda h: h["old_len"]),
        "modified": F.col("modified") - total(free("replace"), lambda h: F.lit(1).cast("long")),
        "moved_blocks": F.col("moved_blocks") - total(inserted_move, lambda h: F.lit(1).cast("long")),
        "moved_lines": F.col("moved_lines") - total(inserted_move, lambda h: h["new_len"]),
        "hunk_count": F.col("hunk_count") - F.size(gone),
        "hunks": still,
    })


def jump(results: DataFrame, kind: str, after: int) -> DataFrame:
    """``next_hunk``: the number of the next hunk of a kind behind ``after``, round the end; null if there is none."""
    at = F.array_compact(F.transform("hunks", lambda h, i: F.when(h["kind"] == kind, i)))
    later = F.filter(at, lambda i: i > after)
    return results.withColumn("next_hunk", F.when(F.size(at) > 0, F.when(F.size(later) > 0, later[0]).otherwise(at[0])))


def merge_lines(old: list[str], new: list[str], hunks: Sequence[dict], choices: dict[int, str], allow_unresolved: bool = False) -> list[str]:
    """Two-way merge: the chosen side of each hunk, the left one where none is chosen and that is allowed."""
    out, at = [], 0
    for k, h in enumerate(hunks):
        pick = choices.get(k)
        if pick not in ("left", "right"):
            if not allow_unresolved:
                raise UnresolvedError(f"hunk {k} has no choice")
            pick = "left"
        end = h["old_start"] + h["old_len"]
        out += old[at : h["old_start"]]
        out += old[h["old_start"] : end] if pick == "left" else new[h["new_start"] : h["new_start"] + h["new_len"]]
        at = end
    return out + old[at:]


def merge_documents(pairs: DataFrame, choices: str | None = None, default: str | None = None, options: LineOptions | None = None, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` with ``merged``, the text that the chosen sides of the hunks give, each line with its own terminator.

    ``choices`` names a map<int, string> column, left or right by hunk number; ``default`` serves hunks without a choice, and
    an open hunk is an error when the plan runs. Every hunk is compared, whatever ``max_hunks``.
    """
    o = replace(options or LineOptions(), max_hunks=1 << 62, moves=False)
    if default not in (None, "left", "right"):
        raise UsageError("the default choice is left or right")
    keep = [c for c in pairs.columns if c not in (old, new, choices)]

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, picked: pd.Series) -> pd.Series:
        out = []
        for x, y, pick in zip(a, b, picked, strict=True):
            p, q, own = split_lines(x), split_lines(y), dict(pick) if pick is not None else {}
            hunks = diff(p, q, o)["hunks"]
            merged = merge_lines(p, q, hunks, {k: own.get(k, default) for k in range(len(hunks))})
            out.append("".join(t + e for t, e in merged))
        return pd.Series(out, dtype=object)

    pick = F.col(choices) if choices else F.lit(None).cast("map<int, string>")
    return pairs.select(*keep, run(F.col(old), F.col(new), pick).alias("merged"))


def minimap(results: DataFrame, keys: Sequence[str], pixels: int, priority: Column | None = None) -> DataFrame:
    """(keys, pixel, hunk, kind): the hunk that a strip of ``pixels`` cells shows in each cell. A hunk takes a unit for its head
    and one for each line of its longer side; of those that meet in a cell the highest ``priority`` wins, then the first."""
    h = hunk_rows(results, *keys).withColumn("units", F.greatest("old_len", "new_len", F.lit(1)) + 1)
    w = Window.partitionBy(*keys)
    upto = F.sum("units").over(w.orderBy("hunk").rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumns({"upto": upto, "total": F.sum("units").over(w), "rank": priority if priority is not None else F.lit(0)})
    first = F.least(F.floor((F.col("upto") - F.col("units")) / F.col("total") * pixels), F.lit(pixels - 1))
    last = F.least(F.greatest(first + 1, F.ceil(F.col("upto") / F.col("total") * pixels)), F.lit(pixels)) - 1
    cells = h.withColumn("pixel", F.explode(F.sequence(first, last)))
    best = F.min(F.struct((-F.col("rank")).alias("r"), "hunk", "kind"))
    return cells.groupBy(*keys, "pixel").agg(best.alias("b")).select(*keys, "pixel", "b.hunk", "b.kind")


def sort_lines(df: DataFrame, line: str = "line", numeric: bool = False, reverse: bool = False) -> DataFrame:
    """Lines in byte order, or numbers first by value and the rest by bytes; ``reverse`` turns the whole order round."""
    return df.orderBy(*sort_keys(F.col(line), numeric, reverse))


def sort_keys(line: Column, numeric: bool = False, reverse: bool = False) -> list[Column]:
    keys = [line]
    if numeric:
        n = normalize.number(line, special=True)
        n = F.when(~F.isnan(n), n)
        keys = [n.isNull(), n, line]
    return [k.desc() if reverse else k.asc() for k in keys]


def sorted_text(text: Column, numeric: bool = False, reverse: bool = False) -> Column:
    """The text with its lines sorted, inside one row."""
    lines = lines_column(text)
    if not numeric:
        done = F.array_sort(lines)
    else:
        n = lambda x: F.when(~F.isnan(normalize.number(x, True)), normalize.number(x, True))
        done = F.transform(F.array_sort(F.transform(lines, lambda x: F.struct(n(x).isNull().alias("t"), n(x).alias("n"), x.alias("x")))), lambda s: s["x"])
    return F.concat_ws("\n", F.reverse(done) if reverse else done)


def diff_sorted(pairs: DataFrame, options: LineOptions | None = None, numeric: bool = False, reverse: bool = False, old: str = "old", new: str = "new") -> DataFrame:
    """``diff_documents`` of both sides' sorted lines."""
    done = pairs.withColumns({c: sorted_text(F.col(c), numeric, reverse) for c in (old, new)})
    return diff_documents(done, replace(options or LineOptions(), ignore_eol=True), old, new)


def multiset_lines(old: DataFrame, new: DataFrame, line: str = "line") -> DataFrame:
    """(line, only_old, only_new): sorted comparison at scale, without bringing a document's lines together."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = old.select(F.col(line).alias("line"), one.alias("o"), zero.alias("n")).unionByName(new.select(F.col(line).alias("line"), zero.alias("o"), one.alias("n")))
    g = both.groupBy("line").agg((F.sum("o") - F.sum("n")).alias("d")).filter("d <> 0")
    return g.select("line", F.greatest(F.lit(0).cast("long"), F.col("d")).alias("only_old"), F.greatest(F.lit(0).cast("long"), -F.col("d")).alias("only_new"))
