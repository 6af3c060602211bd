"""Text encodings: detection from a sample, decoding and encoding, line-ending and BOM profiles."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.plans.options import CompareError, UsageError

SAMPLE = 8192
ENCODINGS = ("utf-8", "utf-16le", "utf-16be", "shift_jis", "euc-jp", "iso-2022-jp")
ALIASES = {"utf8": "utf-8", "utf16le": "utf-16le", "utf16be": "utf-16be", "utf-16": "utf-16le", "sjis": "shift_jis", "shift-jis": "shift_jis", "cp932": "shift_jis", "windows-31j": "shift_jis", "eucjp": "euc-jp", "euc_jp": "euc-jp", "iso2022jp": "iso-2022-jp", "jis": "iso-2022-jp"}
CODECS = {"shift_jis": "cp932", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-8": "utf-8"}
BOMS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16le", b"\xfe\xff": "utf-16be"}


def canonical(name: str) -> str:
    n = name.strip().lower()
    n = ALIASES.get(n, n)
    if n not in ENCODINGS:
        raise UsageError(f"unknown encoding {name!r}")
    return n


def bom(data: bytes) -> bytes:
    return next((b for b in BOMS if data.startswith(b)), b"")


#: Escapes that designate a two-byte set, and the bytes of a character in EUC-JP and in Shift_JIS.
ESCAPES = re.compile(rb"\x1b\$[@B(]")
PAIRS = re.compile(rb"([\xa1-\xfe]{2}|\x8e[\xa1-\xdf])|([\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])|[\x80-\xff]")


def detect(data: bytes, hint: str = "") -> str:
    """Byte order mark, hint, ISO-2022-JP escapes, the zero bytes of UTF-16 (a quarter of all, nine in ten of them on one side;
    big-endian needs two, as one before a short text is binary data), valid UTF-8, else Shift_JIS or EUC-JP, whichever more
    characters fit; from the first 8 KiB."""
    sample = data[:SAMPLE]
    mark = bom(sample)
    if mark:
        return BOMS[mark]
    if hint and hint.lower() != "auto":
        return canonical(hint)
    if ESCAPES.search(sample):
        return "iso-2022-jp"
    whole = sample[: len(sample) & ~1]
    big, little = whole[0::2].count(0), whole[1::2].count(0)
    if len(whole) >= 4 and 4 * (big + little) >= len(whole):
        for name, zeros, least in (("utf-16le", little, 1), ("utf-16be", big, 2)):
            if zeros >= max(least, (big + little) * 9 // 10):
                return name
    for cut in range(4):  # the sample may end inside a character
        try:
            sample[: len(sample) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            if len(sample) < SAMPLE:
                break
    fits = [(bool(m[1]), bool(m[2])) for m in PAIRS.finditer(sample)]
    return "euc-jp" if sum(e for e, _ in fits) > sum(s for _, s in fits) else "shift_jis"


def decode(data: bytes, encoding: str = "", errors: str = "replace") -> str:
    name = detect(data, encoding)
    mark = bom(data)
    return data[len(mark) if BOMS.get(mark) == name else 0 :].decode(CODECS[name], errors=errors)


def is_binary(data: bytes, encoding: str = "") -> bool:
    """A zero byte in the sample, unless the text is UTF-16."""
    return b"\0" in data[:SAMPLE] and not detect(data, encoding).startswith("utf-16")


def decode_column(content: Column, encoding: str = "") -> Column:
    """Text of binary contents, each in its own encoding; null for binary data."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or is_binary(b, encoding) else decode(b, encoding))

    return run(content)


def detect_column(content: Column, hint: str = "") -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else detect(b, hint))

    return run(F.substring(content, 1, SAMPLE))


def refuse_binary(files: DataFrame, content: str = "content") -> DataFrame:
    """Raise where a file is binary, when the plan runs."""
    return files.withColumn(content, F.when(F.position(F.lit(b"\0"), F.substring(content, 1, SAMPLE)) > 0, F.raise_error(F.lit("binary content"))).otherwise(F.col(content)))


@dataclass(frozen=True)
class Profile:
    """What a merge must restore: encoding, byte order mark, line ending, terminator of the last line."""

    encoding: str = "utf-8"
    bom: bool = False
    line_ending: str = "\n"
    final_newline: bool = True


def profile(data: bytes, encoding: str = "") -> Profile:
    name = detect(data, encoding)
    text = decode(data, name)
    crlf, cr = text.count("\r\n"), text.count("\r")
    lf = text.count("\n") - crlf
    ending = max((("\n", lf), ("\r\n", crlf), ("\r", cr - crlf)), key=lambda x: x[1])[0]
    return Profile(name, bool(bom(data)), ending, text.endswith(("\n", "\r")))


def restore(lines: list[str], p: Profile) -> bytes:
    """Merged lines as bytes of the profile; a character that the encoding lacks is an error."""
    text = p.line_ending.join(lines) + (p.line_ending if p.final_newline and lines else "")
    mark = next((b for b, n in BOMS.items() if n == p.encoding), b"") if p.bom else b""
    try:
        return mark + text.encode(CODECS[p.encoding], errors="strict")
    except UnicodeEncodeError as e:
        raise CompareError(f"{e.object[e.start:e.end]!r} has no {p.encoding} form") from e
