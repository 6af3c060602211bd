"""Predicates over paths and file attributes: globs, hidden names, and the filter language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from rowloom.plans.options import UsageError

UNITS = {"": 1, "b": 1, **{u: 1000**i for i, u in enumerate(("k", "m", "g", "t"), 1)}, **{u + "b": 1000**i for i, u in enumerate(("k", "m", "g", "t"), 1)}, **{u + "ib": 1024**i for i, u in enumerate(("k", "m", "g", "t"), 1)}}


def byte_size(text: str) -> int:
    """``1.5GiB`` and the like as bytes; a bare number counts bytes."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise UsageError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].lower()])


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, as it is written; empty if there is none."""
    return F.regexp_extract(base(path), r"(?s)(\.[^.]*)$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


_RANGE = re.compile(r"(?s)(?:\\(.)|([^\\\]-]))(?:-(?:\\(.)|([^\\\]-])))?")


def _class(seg: str, i: int) -> tuple[str, int] | None:
    """The class that begins behind the bracket at i, as a regular expression, and the place of its end. A circumflex negates,
    a backslash quotes; None if it is malformed."""
    negated = seg.startswith("^", i + 1)
    at, ranges = i + 1 + negated, ""
    while not (seg.startswith("]", at) and at > i + 1 + negated):
        m = _RANGE.match(seg, at)
        if not m:
            return None
        lo = m[1] or m[2]
        hi = m[3] or m[4] or lo
        ranges += f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}" if lo <= hi else ""
        at = m.end()
    if not ranges:
        return ("(?s:.)" if negated else "(?!)"), at
    return f"[{'^' if negated else ''}{ranges}]", at


def glob_regex(glob: str) -> str | None:
    """A glob as an anchored regular expression; ``**`` as a segment spans any depth. None if it is malformed."""
    parts = []
    segments = glob.split("/")
    for k, seg in enumerate(segments):
        if seg == "**":
            if k == len(segments) - 1:
                parts.append("(?:/.*)?" if k else ".*")
            else:
                parts.append("(?:/[^/]+)*" if k else "(?:[^/]+/)*")
            continue
        out, i = "", 0
        while i < len(seg):
            c = seg[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[":
                found = _class(seg, i)
                if not found:
                    return None
                out += found[0]
                i = found[1]
            elif c == "\\":
                if i + 1 == len(seg):
                    return None
                i += 1
                out += re.escape(seg[i])
            else:
                out += re.escape(c)
            i += 1
        lead = "/" if k and not (k == 1 and segments[0] == "**") else ""
        parts.append(lead + out)
    return "^" + "".join(parts) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    """On the whole relative path or on its last name; a malformed glob matches nothing."""
    rx = glob_regex(glob)
    if rx is None:
        return F.lit(False)
    return path.rlike(rx) | base(path).rlike(rx)


#: Built-in filter sets (include globs, exclude globs, expressions).
FILTER_SETS = {
    "vcs": {"exclude": [".git/**", ".hg/**", ".svn/**"]},
    "node": {"exclude": ["node_modules/**", ".next/**", "dist/**"]},
    "rust": {"exclude": ["target/**"]},
    "development": {"exclude": [".git/**", ".hg/**", ".svn/**", "node_modules/**", ".next/**", "target/**", "dist/**", "build/**", "*.tmp", "*.swp"]},
}


@dataclass(frozen=True)
class PathFilter:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    expressions: tuple[str, ...] = ()
    hidden: bool = True
    sets: tuple[str, ...] = ()
    own_sets: dict = field(default_factory=dict)

    def column(self, path: str = "path") -> Column:
        """Whether a file takes part: any include, no exclude, all expressions."""
        known = {**FILTER_SETS, **self.own_sets}
        include, exclude, expressions = list(self.include), list(self.exclude), list(self.expressions)
        for s in self.sets:
            if s not in known:
                raise UsageError(f"no filter set {s!r}")
            include += known[s].get("include", [])
            exclude += known[s].get("exclude", [])
            expressions += known[s].get("expressions", [])
        p = F.col(path)
        out = F.lit(True)
        if include:
            out = F.lit(False)
            for g in include:
                out = out | matches_glob(p, g)
        for g in exclude:
            out = out & ~matches_glob(p, g)
        for e in expressions:
            out = out & expression(e, path)
        return out if self.hidden else out & ~hidden(p)


_LEX = re.compile(r"""\s*(?:(?P<op><=|>=|==|!=|=~|!~|<|>)|(?P<paren>[()])|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<word>[^\s()<>=!"']+))""")
_FIELDS = ("size", "name", "path", "ext", "mtime")


def expression(text: str, path: str = "path", size: str = "size", mtime: str = "mtime") -> Column:
    """``size >= 1MiB and not (ext == ".tmp" or path =~ "^old/")`` as a column; precedence: not, and, or."""
    at, tokens = 0, []
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise UsageError(f"can't read the filter at {text[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    parser = _Filter(tokens, path, size, mtime)
    out = parser.either()
    if parser.tokens:
        raise UsageError(f"the filter goes on with {parser.tokens[0][1]!r}")
    return out


class _Filter:
    def __init__(self, tokens: list, path: str, size: str, mtime: str):
        self.tokens = tokens
        p = F.col(path)
        self.of = {"size": F.col(size), "name": base(p), "path": p, "ext": extension(p), "mtime": F.col(mtime)}

    def _word(self, *words: str) -> bool:
        if self.tokens and self.tokens[0][0] == "word" and self.tokens[0][1].lower() in words:
            self.tokens.pop(0)
            return True
        return False

    def _next(self, what: str):
        if not self.tokens:
            raise UsageError(f"the filter ends where {what} should be")
        return self.tokens.pop(0)

    def either(self) -> Column:
        out = self.both()
        while self._word("or"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self._word("and"):
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self._word("not"):
            return ~self.one()
        kind, name = self._next("a field")
        if (kind, name) == ("paren", "("):
            out = self.either()
            if self._next("a closing parenthesis") != ("paren", ")"):
                raise UsageError("a parenthesis is not closed")
            return out
        if kind != "word" or name.lower() not in _FIELDS:
            raise UsageError(f"no field {name!r}")
        kind, op = self._next("an operator")
        if kind != "op":
            raise UsageError(f"no operator {op!r}")
        kind, value = self._next("a value")
        if kind not in ("text", "word"):
            raise UsageError(f"no value {value!r}")
        if kind == "text":
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        return self._test(name.lower(), op, value)

    def _test(self, name: str, op: str, value: str) -> Column:
        c = self.of[name]
        if op in ("=~", "!~"):
            if name in ("size", "mtime"):
                raise UsageError(f"{name} is not text")
            from rowloom.plans.options import java_pattern

            hit = c.rlike(java_pattern(value))
            return hit if op == "=~" else ~hit
        if name == "size":
            v = F.lit(byte_size(value))
        elif name == "mtime":
            v = F.lit(moment(value))
        else:
            if op not in ("==", "!="):
                raise UsageError(f"{op} does not order text")
            v = F.lit(value)
        return {"<": c < v, "<=": c <= v, "==": c == v, "!=": c != v, ">": c > v, ">=": c >= v}[op]


def moment(text: str) -> datetime:
    """RFC 3339, or a date (midnight UTC)."""
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise UsageError(f"not a time: {text!r}") from e
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
