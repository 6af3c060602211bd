"""Saved comparisons: JSON with paths relative to the project file."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field

from rowloom.plans.options import UsageError

VERSION = 1


@dataclass
class Project:
    mode: str = "csv"
    left: str = ""
    right: str = ""
    base: str = ""
    options: dict = field(default_factory=dict)


def load(path: str) -> Project:
    """Unknown fields and versions fail."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if raw.pop("version", None) != VERSION:
        raise UsageError("unsupported project version")
    unknown = set(raw) - set(Project.__dataclass_fields__)
    if unknown:
        raise UsageError(f"unknown project fields: {', '.join(sorted(unknown))}")
    p = Project(**raw)
    folder = os.path.dirname(os.path.abspath(path))
    for side in ("left", "right", "base"):
        at = getattr(p, side)
        setattr(p, side, os.path.normpath(os.path.join(folder, at)) if at else "")
    return p


def save(p: Project, path: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    raw = {"version": VERSION, **asdict(p)}
    for side in ("left", "right", "base"):
        raw[side] = os.path.relpath(raw[side], folder) if raw[side] else ""
    write_whole(path, json.dumps(raw, indent=2, ensure_ascii=False).encode() + b"\n")


def write_whole(path: str, data: bytes) -> None:
    """All of the bytes or none: a temporary neighbour, flushed, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, name = tempfile.mkstemp(prefix=".rowloom-", dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def distinct_output(output: str, *inputs: str) -> None:
    """Refuse to write over an input, under whatever name."""
    for i in inputs:
        same = os.path.abspath(i) == os.path.abspath(output) or (os.path.exists(i) and os.path.exists(output) and os.path.samefile(i, output))
        if same:
            raise UsageError(f"{output} is an input")
