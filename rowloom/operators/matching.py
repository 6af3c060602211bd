"""Matching inside one key group: most pairs under a tolerance, then pairs of least change."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def maximum_matching(near: np.ndarray) -> list[int]:
    """Partner of each left row (or -1) in a matching of most pairs of the bipartite graph ``near`` (left x right).

    Left rows look for a partner one after another; a shortest chain of re-assignments, found breadth first over right
    rows in order, makes room where all partners are taken.
    """
    partner, holder = [-1] * near.shape[0], [-1] * near.shape[1]
    options = [np.flatnonzero(row).tolist() for row in near]
    for start in range(len(options)):
        came: dict[int, int] = {}
        line, end = deque([start]), -1
        while line and end < 0:
            at = line.popleft()
            for r in options[at]:
                if r in came:
                    continue
                came[r] = at
                if holder[r] < 0:
                    end = r
                    break
                line.append(holder[r])
        while end >= 0:
            at = came[end]
            partner[at], holder[end], end = end, at, partner[at]
    return partner


#: Pairs of copies that are matched one by one, and pairs of distinct rows that a group may have at most.
COPIES, PAIRS = 1 << 22, 1 << 28


def matched_copies(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many copies of each distinct row find a partner in a largest matching; ``left`` and ``right`` count the copies.

    As in ``maximum_matching``, but a chain of re-assignments moves as many copies at once as all of its links allow.
    """
    options = [np.flatnonzero(row).tolist() for row in near]
    open_, free = left.tolist(), right.tolist()
    held: list[dict[int, int]] = [{} for _ in free]
    for start in range(len(options)):
        while open_[start]:
            came: dict[int, int] = {}
            left_by: dict[int, int] = {start: -1}
            line, end = deque([start]), -1
            while line and end < 0:
                at = line.popleft()
                for r in options[at]:
                    if r in came:
                        continue
                    came[r] = at
                    if free[r]:
                        end = r
                        break
                    for x in held[r]:
                        if x not in left_by:
                            left_by[x] = r
                            line.append(x)
            if end < 0:
                break
            chain, r = [], end
            while r >= 0:
                chain.append((came[r], r))
                r = left_by[came[r]]
            n = min(open_[start], free[end], *(held[left_by[x]][x] for x, _ in chain if left_by[x] >= 0))
            for x, r in chain:
                held[r][x] = held[r].get(x, 0) + n
                was = left_by[x]
                if was >= 0:
                    held[was][x] -= n
                    if not held[was][x]:
                        del held[was][x]
            open_[start] -= n
            free[end] -= n
    return left - np.array(open_, np.int64), right - np.array(free, np.int64)


def least_change(cost: np.ndarray, most: int) -> list[int]:
    """Partner of each left row (or -1): pairs by rising cost, then left, then right row; beyond ``most`` possible pairs,
    row by row, which is how such groups are defined to pair."""
    n, m = cost.shape
    if n * m > most:
        return [i if i < m else -1 for i in range(n)]
    out, used = [-1] * n, [False] * m
    for at in np.argsort(cost, axis=None, kind="stable").tolist():
        i, j = divmod(at, m)
        if out[i] < 0 and not used[j]:
            out[i], used[j] = j, True
    return out


def by_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema, rows: int = 20_000) -> DataFrame:
    """Deal ``df`` out by ``keys`` and hand ``run`` tables of whole groups, sorted by ``order``, with the place where each
    group begins (and the end): many small groups share a call, a large one has its own."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < rows:
                continue
            all_ = pd.concat(held, ignore_index=True)
            cut = int(_starts(all_, keys)[-2])  # the last group may go on
            if cut:
                yield _call(all_.iloc[:cut].reset_index(drop=True))
            held = [all_.iloc[cut:]]
        if held:
            all_ = pd.concat(held, ignore_index=True)
            if len(all_):
                yield _call(all_)

    def _call(frame: pd.DataFrame) -> pd.DataFrame:
        return run(frame, _starts(frame, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(stream, schema)


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for k in keys:
        code = pd.factorize(frame[k], use_na_sentinel=False)[0]
        new[1:] |= code[1:] != code[:-1]
    return np.r_[np.flatnonzero(new), len(frame)]
