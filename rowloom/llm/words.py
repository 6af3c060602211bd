"""Words and rolling hashes of a batch of texts, as numpy arrays over one byte buffer.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials modulo 2**64 over the bytes of a word
(and over the hashes of the words of a span), so the hash of any span is one subtraction and one product. Bytes are taken
in pieces of ``PIECE``: beside the texts themselves memory goes to three numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C55 | 1
MASK = (1 << 64) - 1
BASE_INV = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes that are hashed together; powers of the base are kept for so many places.
PIECE = 1 << 18


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


@cache
def _kept() -> tuple[np.ndarray, np.ndarray]:
    return _table(PIECE + 2)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n at least."""
    return _kept() if n <= PIECE + 2 else _table(n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """P with span hash = (P[e] - P[s]) * BASE**-s."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=U64)
    return out


def spans(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return (p[e] - p[s]) * down[s]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each of the spans [start, end), which are in order."""
    out = np.zeros(len(start), U64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(end, a + PIECE, "right"))
        if j <= i:  # a span longer than a piece
            for at in range(a, int(end[i]), PIECE):
                part = prefix(data[at : min(at + PIECE, int(end[i]))].astype(U64) + U64(1))[-1:]
                out[i : i + 1] += part * U64(pow(BASE, at - a, 1 << 64))
            i += 1
            continue
        p = prefix(data[a : int(end[j - 1])].astype(U64) + U64(1))
        out[i:j] = spans(p, start[i:j] - a, end[i:j] - a)
        i = j
    return mix(out + (end - start).astype(U64))


class Words:
    """Words of some texts: byte start and end, 64-bit hash; first[i]:first[i+1] are text i's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: lower-cased bytes of all texts; offsets: where each text begins, and the end."""
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = 16 * PIECE
        for a in range(0, len(data), size):
            b = min(a + size, len(data))
            # inside[i] tells of byte a - 1 + i, so that a piece sees the byte on either side
            inside = ~SPACE[np.r_[np.uint8(32) if a == 0 else data[a - 1], data[a:b], data[b] if b < len(data) else np.uint8(32)]]
            edge = np.zeros(b - a + 1, bool)
            edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
            own = inside[1:-1]
            starts.append(np.flatnonzero(own & (~inside[:-2] | edge[:-1])) + a)
            ends.append(np.flatnonzero(own & (~inside[2:] | edge[1:])) + a + 1)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.data, self.offsets = data, offsets
        self.hash = self.cut(self.start, self.end)

    def cut(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes [start, end)."""
        return byte_hashes(self.data, start, end)


def chunks(texts: pa.Array, most: int = 1 << 18, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of whole texts of about ``most`` bytes; null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        part = data[off[i] : off[j]]
        yield i, LOWER[part] if lower else part, (off[i : j + 1] - off[i])
        i = j


def shingles(words: Words, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k words from each word on (from those in ``at``), whatever text they end in; the caller keeps to one text."""
    h = words.hash
    if at is None:
        n = max(0, len(h) - k + 1)
        parts = (h[j : j + n] for j in range(k))
    else:
        n, parts = len(at), (h[at + j] for j in range(k))
    out, up = np.full(n, k, U64), _kept()[0]
    for j, part in enumerate(parts):
        out += part * up[j]
    return mix(out)
