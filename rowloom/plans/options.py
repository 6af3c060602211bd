"""Options of the comparison operators, their validation, and the errors they raise."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

WHITESPACE = ("keep", "change", "all")


class RowloomError(Exception):
    """Base of all errors of the package; ``exit_code`` is the one a command line would return."""

    exit_code = 3


class UsageError(RowloomError, ValueError):
    """The options contradict each other or the inputs."""

    exit_code = 2


class CompareError(RowloomError):
    """The inputs can't be compared: ragged records, binary text, limits exceeded."""


class UnresolvedError(CompareError):
    """A merge was asked for that leaves differences without a choice."""

    exit_code = 1


#: Constructs of Java regular expressions that RE2 does not have; patterns with them are refused.
_NOT_RE2 = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


def java_pattern(pattern: str) -> str:
    """An RE2 pattern as Java reads it: named groups, ASCII ``\\s`` and ``$`` at the very end only."""
    if _NOT_RE2.search(pattern.replace("\\\\", "")):
        raise UsageError(f"pattern {pattern!r} uses look-around, a back reference or a possessive repeat")
    out, i, in_class = [], 0, False
    multiline = pattern.startswith("(?") and "m" in pattern[2 : pattern.find(")")]
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s" or two == "\\S":
            body = r"\t\n\f\r "
            out.append(body if in_class and two == "\\s" else f"[{'^' if two == chr(92) + 'S' else ''}{body}]")
            i += 2
        elif two == "\\z":
            out.append(r"\z")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif pattern[i] == "$" and not in_class and not multiline:
            out.append(r"\z")
            i += 1
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    java = "".join(out)
    try:
        re.compile(pattern.replace("\\z", "\\Z"))
    except re.error as e:
        raise UsageError(f"bad pattern {pattern!r}: {e}") from e
    return java


@dataclass(frozen=True)
class Rules:
    """How values are normalised before they are compared; outputs always show the originals."""

    ignore_case: bool = False
    whitespace: str = "keep"
    filters: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.whitespace not in WHITESPACE:
            raise UsageError(f"whitespace must be one of {', '.join(WHITESPACE)}")
        for p in self.filters:
            java_pattern(p)

    @property
    def on(self) -> bool:
        return self.ignore_case or self.whitespace != "keep" or bool(self.filters)


@dataclass(frozen=True)
class TableOptions:
    """Options of the keyed table comparison.

    ``keys`` or ``exclude_keys`` name the key (names, or indexes counted from ``index_base``); neither means all columns
    but those ignored or under a tolerance of their own. ``tolerance`` holds for every compared column, ``tolerances`` by
    column. ``cell_diff`` pairs changed rows and lists the changed columns. ``skew_safe`` says whether a key may hold much of
    the data; by default that is measured.
    """

    keys: Sequence[str | int] = ()
    exclude_keys: Sequence[str | int] = ()
    index_base: int = 0
    align_by_name: bool = True
    has_header: bool = True
    rules: Rules = field(default_factory=Rules)
    ignore: Sequence[str | int] = ()
    tolerance: float | None = None
    tolerances: Mapping[str, float] = field(default_factory=dict)
    cell_diff: bool = False
    max_similarity_pairs: int = 4096
    skew_safe: bool | None = None

    def __post_init__(self) -> None:
        if self.keys and self.exclude_keys:
            raise UsageError("give keys or exclude_keys, not both")
        if self.index_base not in (0, 1):
            raise UsageError("index_base is 0 or 1")
        for t in [self.tolerance, *self.tolerances.values()]:
            if t is not None and not 0 <= t < float("inf"):
                raise UsageError("a tolerance is a finite number from 0 on")


@dataclass(frozen=True)
class TablePlan:
    """What the options mean for two given schemas."""

    columns: list[str]
    right: list[str]
    key: list[str]
    ignored: list[str]
    tolerance: dict[str, float]
    full_row_key: bool
    options: TableOptions

    @property
    def rules_on(self) -> bool:
        return self.options.rules.on or bool(self.ignored) or bool(self.tolerance)

    @property
    def compared(self) -> list[str]:
        return [c for c in self.columns if c not in self.ignored]


def _unique(names: Sequence[str], side: str) -> None:
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise UsageError(f"the {side} table names a column twice: {', '.join(twice)}")


def _pick(picks: Sequence[str | int], columns: list[str], o: TableOptions) -> list[str]:
    out: list[str] = []
    for p in picks:
        if isinstance(p, str):
            if not o.has_header:
                raise UsageError("column names need a header; use indexes")
            if p not in columns:
                raise UsageError(f"no column {p!r}")
            name = p
        else:
            if not o.index_base <= p < len(columns) + o.index_base:
                raise UsageError(f"no column {p}")
            name = columns[p - o.index_base]
        if name not in out:
            out.append(name)
    return out


def plan_tables(left: Sequence[str], right: Sequence[str], o: TableOptions) -> TablePlan:
    """Check both headers against the options and settle columns, key and rules."""
    left, right = list(left), list(right)
    if len(left) != len(right):
        raise UsageError(f"the left table has {len(left)} columns, the right one {len(right)}")
    if o.has_header:
        _unique(left, "left")
        _unique(right, "right")
        if o.align_by_name:
            missing = [c for c in left if c not in right]
            if missing:
                raise UsageError(f"the right table lacks {', '.join(missing)}")
            order = left
        elif left != right:
            raise UsageError("the headers differ; align by name or rename")
        else:
            order = right
    else:
        order = right
    ignored = _pick(o.ignore, left, o)
    own = {c: float(t) for c, t in o.tolerances.items()}
    for c in own:
        if c not in left:
            raise UsageError(f"no column {c!r}")
    if o.keys:
        key = _pick(o.keys, left, o)
    elif o.exclude_keys:
        out = _pick(o.exclude_keys, left, o)
        key = [c for c in left if c not in out]
    else:
        key = [c for c in left if c not in ignored and c not in own]
        if o.tolerance is not None:
            raise UsageError("a tolerance for all columns needs an explicit key")
    if not key:
        raise UsageError("no key columns remain")
    on_key = [c for c in own if c in key]
    if on_key:
        raise UsageError(f"a tolerance on key columns: {', '.join(on_key)}")
    if o.tolerance is not None and key == left:
        raise UsageError("a tolerance has nothing to compare when all columns are the key")
    tolerance = dict.fromkeys([c for c in left if c not in key and c not in ignored], o.tolerance) if o.tolerance is not None else {}
    tolerance.update({c: t for c, t in own.items() if c not in ignored})
    plain = not (o.rules.on or ignored or tolerance)
    return TablePlan(left, order, key, ignored, tolerance, plain and key == left, o)
