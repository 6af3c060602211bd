"""Word differences inside changed lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MAX_TOKENS = 2000, 260
#: Scripts written without spaces: each of their characters is a word.
ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
TOKEN = regex.compile(rf"[\t\n\f\r ]+|[{ALONE}]|[\p{{L}}\p{{M}}\p{{N}}_--{ALONE}]+|[^\t\n\f\r \p{{L}}\p{{M}}\p{{N}}_{ALONE}]+", regex.V1)
JAVA_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
JAVA_TOKEN = rf"([\t\n\f\r ]+|[{JAVA_ALONE}]|[\p{{L}}\p{{M}}\p{{N}}_&&[^{JAVA_ALONE}]]+|[^\t\n\f\r \p{{L}}\p{{M}}\p{{N}}_{JAVA_ALONE}]+)"
SEGMENTS = "array<struct<text: string, changed: boolean>>"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(JAVA_TOKEN), F.lit(0))


def word_diff(old: str | None, new: str | None) -> tuple[list, list] | None:
    """Segments (text, changed) of both sides by a longest common subsequence of words; None if the texts are equal or too
    long to be worth it."""
    if old is None or new is None or old == new or len(old) + len(new) > MAX_CHARS:
        return None
    a, b = TOKEN.findall(old), TOKEN.findall(new)
    if len(a) + len(b) > MAX_TOKENS:
        return None
    codes = {t: i for i, t in enumerate(dict.fromkeys(a + b))}
    x, y = [codes[t] for t in a], np.array([codes[t] for t in b], int)
    # rest[i][j]: longest common subsequence of the words from i and from j on
    rest = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a) - 1, -1, -1):
        step = np.maximum(rest[i + 1, :-1], np.where(y == x[i], rest[i + 1, 1:] + 1, 0))
        rest[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    left, right, i, j = [], [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            _add(left, a[i], False)
            _add(right, b[j], False)
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and rest[i + 1, j] >= rest[i, j + 1]):
            _add(left, a[i], True)
            i += 1
        else:
            _add(right, b[j], True)
            j += 1
    return left, right


def _add(out: list, text: str, changed: bool) -> None:
    if out and out[-1][1] == changed:
        out[-1] = (out[-1][0] + text, changed)
    else:
        out.append((text, changed))


def diff_words(df: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """``df`` with old_segments and new_segments; both null where there is no word difference to show."""

    @F.pandas_udf(f"struct<old_segments: {SEGMENTS}, new_segments: {SEGMENTS}>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [word_diff(x, y) for x, y in zip(a, b, strict=True)]
        named = lambda k: [None if f is None else [{"text": t, "changed": c} for t, c in f[k]] for f in found]
        return pd.DataFrame({"old_segments": named(0), "new_segments": named(1)})

    return df.withColumn("w", run(F.col(old), F.col(new))).select(*df.columns, "w.*")
