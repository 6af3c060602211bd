"""Benchmark decontamination by SimHash over item-sized windows.

Each item is the multiset of its five-word shingles (lower-cased words; an item of fewer words is one shingle). A document
is read through windows of every item's length in words. A window of similarity ``threshold`` shares so many shingles with
an item that few windows can: those with too few that any item of their length holds, told by running sums, have a lower
similarity for certain and are left out. Of the others the SimHash is looked up in multi-index Hamming blocks: eight blocks of
eight bits, each with lists of the items of that length by value, within radius // 8 bits, so that every fingerprint within
``radius`` is found. The radius is fitted to the threshold: vectors of that cosine differ in 64 * acos(cosine) / pi bits on
average, and three standard deviations are added. By chance one pair in 60 is as near as that, so candidates must also be within the
radius fitted for ``MORE`` further words of 64 bits before they are verified by the weighted shingle similarity
2 * sum(min(counts)) / (sum of both counts) >= ``threshold``.

The items travel to the tasks in blocks of a bounded size. If there is more than one, documents first pass a bit map of all
items' shingles, and each block is held against those that pass only; its broadcast goes once its result is written.
Defined cases: null and empty texts and items match nothing; an item with a null item_id counts like any other; a document
shorter than an item is one window; repeated rows give repeated results, ties go to the first window; an empty table on
either side finds nothing and drops nothing; extra columns are kept by ``drop_contaminated`` and ignored by ``find_leaks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import sieve, store
from rowloom.llm.words import LOWER, Words, chunks, mix, shingles

K, BLOCKS = 5, 8
#: Words of 64 bits of a fingerprint beside the one that the blocks index.
MORE = 3
SALTS = [0] + [0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(MORE)]
THRESHOLD = 0.8
#: Bytes of item text in one block.
BLOCK_BYTES = 4 << 20
#: Windows that are fingerprinted together, and pairs of windows and items that are compared together.
WINDOWS, PAIRS = 1 << 14, 1 << 20

LEAK = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"


def fitted_radius(threshold: float, bits: int = 64) -> int:
    """Bits that vectors of the cosine ``threshold`` differ in, but for one in about 700."""
    p = acos(max(-1.0, min(1.0, threshold))) / pi
    return min(bits, ceil(bits * p + 3 * sqrt(bits * p * (1 - p))))


RADIUS = fitted_radius(THRESHOLD)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(ones: np.ndarray, n) -> np.ndarray:
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(runs, 1 + MORE) words: SimHashes of each run h[first:first + count]; the runs are in order and may overlap. Bits are
    summed in bounded pieces."""
    out = np.zeros((len(first), 1 + MORE), np.uint64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + WINDOWS)))
        lo, hi = int(first[a]), int((first[a:b] + count[a:b]).max())
        s = first[a:b] - lo
        for k, salt in enumerate(SALTS):
            run = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(_bits(mix(h[lo:hi] ^ np.uint64(salt)) if salt else h[lo:hi]), axis=0, out=run[1:], dtype=np.int32)
            out[a:b, k] = _majority(run[s + count[a:b]] - run[s], count[a:b, None])
        a = b
    return out


class Length:
    """The items of one length in words: fingerprints, Hamming blocks and shingle counts."""

    def __init__(self, n: int, kk: int, at: np.ndarray, h: np.ndarray):
        """at: their numbers; h: their shingles, n - kk + 1 each."""
        self.n, self.kk, self.at, self.count = n, kk, at, n - kk + 1
        fps = _fingerprints(h, np.arange(len(at)) * self.count, np.full(len(at), self.count))
        self.fps, self.more = np.ascontiguousarray(fps[:, 0]), fps[:, 1:]
        self.known = np.unique(h)
        self.h = np.sort(h.reshape(len(at), self.count), axis=1)
        # items by the value of each block: order[b][first[b][v]:first[b][v + 1]]
        part = self.fps.view(np.uint8).reshape(-1, BLOCKS)
        self.order = [np.argsort(part[:, b], kind="stable") for b in range(BLOCKS)]
        self.first = [np.searchsorted(part[o, b], np.arange(257)) for b, o in enumerate(self.order)]

    def fetch(self, fps: np.ndarray, radius: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) whose fingerprints are at most ``radius`` bits apart, and ``far`` bits in the further words, in bounded
        pieces, each pair once: in the first block in which it meets."""
        near = np.arange(256, dtype=np.uint8)
        near = near[np.bitwise_count(near) <= radius // BLOCKS]
        fp, more = np.ascontiguousarray(fps[:, 0]), fps[:, 1:]
        part = fp.view(np.uint8).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            value = (part[:, b, None] ^ near[None]).astype(np.int64)
            lo, size = self.first[b][value], self.first[b][value + 1] - self.first[b][value]
            w = np.repeat(np.arange(len(fp)), len(near))
            lo, size = lo.ravel(), size.ravel()
            total = np.r_[0, np.cumsum(size)]
            i = 0
            while i < len(w):
                j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
                c = size[i:j]
                item = self.order[b][np.arange(c.sum()) - np.repeat(total[i:j] - total[i], c) + np.repeat(lo[i:j], c)]
                win = np.repeat(w[i:j], c)
                apart = fp[win] ^ self.fps[item]
                ok = np.bitwise_count(apart) <= radius
                win, item, apart = win[ok], item[ok], apart[ok]
                ok = np.bitwise_count(more[win] ^ self.more[item]).sum(axis=1, dtype=np.int64) <= far
                win, item, apart = win[ok], item[ok], apart[ok]
                early = np.bitwise_count(apart.view(np.uint8)).reshape(-1, BLOCKS)[:, :b] <= radius // BLOCKS
                yield win[~early.any(axis=1)], item[~early.any(axis=1)]
                i = j

    def shared(self, own: np.ndarray, item: int) -> int:
        """Sum of the smaller counts of a window's shingles ``own`` and the item's."""
        u, n = np.unique(own, return_counts=True)
        left, right = np.searchsorted(self.h[item], u), np.searchsorted(self.h[item], u, "right")
        return int(np.minimum(n, right - left).sum())


class Items:
    """Index of a block of items, by length in words."""

    def __init__(self, rows: list[tuple[int | None, str]], k: int = K, radius: int = RADIUS):
        self.k, self.radius = k, radius
        self.names = [i for i, _ in rows]
        texts = [t.encode() for _, t in rows]
        data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        words = Words(data, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
        size = np.diff(words.first)
        self.of: dict[int, list[Length]] = {}
        for n in np.unique(size[size > 0]).tolist():
            at, kk = np.flatnonzero(size == n), min(k, n)
            begin = words.first[at][:, None] + np.arange(n - kk + 1)
            self.of.setdefault(kk, []).append(Length(n, kk, at, shingles(words, kk, begin.ravel())))
        self.any = {kk: np.unique(np.concatenate([x.known for x in lengths])) for kk, lengths in self.of.items()}

    def find(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple]:
        """(text index, item_id, start word, words, distance, similarity): the best window of each text and item."""
        words = Words(data, offsets)
        best: dict[tuple, tuple] = {}
        for kk, lengths in self.of.items():
            h = shingles(words, kk)
            hit = np.flatnonzero(_among(h, self.any[kk]))
            text = np.searchsorted(words.first, hit, "right") - 1
            inside = hit + kk <= words.first[text + 1]
            hit, text = hit[inside], text[inside]
            if not len(hit):
                continue
            for x in lengths:
                for row in self._windows(x, words, h, hit, text, threshold):
                    key, rank = (row[0], self.names[row[1]]), (-row[5], row[2])
                    if key not in best or rank < best[key][0]:
                        best[key] = (rank, row)
        for (i, name), (_, row) in sorted(best.items(), key=lambda e: (e[0][0], e[0][1] is None, e[0][1] or 0)):
            yield (i, name, int(row[2] - words.first[i]), *row[3:])

    def _windows(self, x: Length, words: Words, h, hit, text, threshold) -> Iterator[tuple]:
        mine = _among(h[hit], x.known)
        p, t = hit[mine], text[mine]
        size = words.first[t + 1] - words.first[t]
        # starts of the windows that hold p's shingle, each text's own
        low = words.first[t]
        high = np.maximum(low, low + size - x.n)
        a, b = np.clip(p - (x.count - 1), low, high), np.clip(p, low, high)
        # windows with known shingles enough: c of the window's and count of the item's, of which both must share this many
        for start, own in _starts(a, b, t):
            c = np.minimum(words.first[own + 1] - words.first[own], x.n) - x.kk + 1
            known = np.searchsorted(p, start + c) - np.searchsorted(p, start)
            enough = 2 * known >= threshold * (c + x.count)
            start, own, c = start[enough], own[enough], c[enough]
            if not len(start):
                continue
            fp = _fingerprints(h, start, c)
            for win, item in x.fetch(fp, self.radius, fitted_radius(threshold, 64 * MORE)):
                for w, i in zip(win.tolist(), item.tolist(), strict=True):
                    s, m = int(start[w]), int(c[w])
                    sim = 2.0 * x.shared(h[s : s + m], i) / (m + x.count)
                    if sim >= threshold:
                        yield int(own[w]), int(x.at[i]), s, m + x.kk - 1, int(np.bitwise_count(fp[w, 0] ^ x.fps[i])), sim


def _starts(a: np.ndarray, b: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct numbers in the ranges [a, b], which are in order, with the text of each, in bounded pieces."""
    done = -1
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(a, a[i] + WINDOWS)))
        lo = np.maximum(a[i:j], np.r_[done, np.maximum.accumulate(np.maximum(b[i:j], done))[:-1]] + 1)
        n = np.maximum(b[i:j] - lo + 1, 0)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        yield start, np.repeat(text[i:j], n)
        done = max(done, int(b[i:j].max()))
        i = j


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Callable[[int], list]]:
    """The number of blocks of about ``block_bytes`` of item text, and the rows of the block of a number."""
    b = store.columns(benchmark, "item_id", "text").filter("text is not null").distinct()
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)

    def rows(k: int) -> list[tuple[int | None, str]]:
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        return sorted(((r.item_id, r.text) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    return n, rows


def _suspects(docs: DataFrame, benchmark: DataFrame):
    """A broadcast bit map of the shingles of all items, and of which documents it tells that none can be in them."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, off in chunks(b.column("text")):
                words = Words(data, off)
                for i, n in enumerate(np.diff(words.first).tolist()):
                    if n:
                        kk = min(K, n)
                        h = shingles(words, kk, np.arange(words.first[i], words.first[i + 1] - kk + 1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], ["key"])

    found = sieve.broadcast(docs.sparkSession, store.columns(benchmark, "text").mapInArrow(keys, "key long").distinct())

    def passes(column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), bool)
        for i, data, off in chunks(column):
            words = Words(data, off)
            for kk in range(1, K + 1):
                hit = np.flatnonzero(sieve.among(shingles(words, kk).view(np.int64), found.value))
                text = np.searchsorted(words.first, hit, "right") - 1
                out[i + text[hit + kk <= words.first[text + 1]]] = True
        return out

    return found, passes


def _held_against(docs: DataFrame, benchmark: DataFrame, radius: int, block_bytes: int, keep: Callable, schema: str, join: Callable) -> DataFrame | None:
    """``keep(index, batch)`` of every batch of ``docs``, for each block of items; None without items. Several blocks are
    put together by ``join``, over the documents that the map of all shingles lets through; keep(None, batch) gives the others."""
    spark = docs.sparkSession
    store.small_batches(spark)
    n, rows = item_blocks(benchmark, block_bytes)

    def against(d: DataFrame, index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield keep(index.value, b)

        return d.mapInArrow(run, schema)

    if n <= 1:
        return against(docs, spark.sparkContext.broadcast(Items(rows(0), K, radius))) if n else None
    found, passes = _suspects(docs, benchmark)
    if found is None:
        some, rest = docs, None
    else:

        def part(inside: bool) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(passes(b.column("text")) == inside))

            return docs.mapInArrow(run, docs.schema)

        some, rest = store.keep(part(True), "leak-suspects"), part(False)
    out = None
    for k in range(n):
        index = spark.sparkContext.broadcast(Items(rows(k), K, radius))
        out, some = join(out, store.keep(against(some, index), "leak-block"), some)
        index.destroy()
    return out if rest is None or schema is LEAK else rest.unionByName(out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item found in it, with its best window."""
    names = ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())

    def keep(index: Items, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column("doc_id").cast(pa.int64())
        found = [(ids[i + f[0]].as_py(), *f[1:]) for i, data, off in chunks(b.column("text")) for f in index.find(data, off, threshold)]
        cols = list(zip(*found, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    out = _held_against(
        store.columns(docs, "doc_id", "text"), benchmark, radius, block_bytes, keep, LEAK, lambda out, new, some: (new if out is None else out.unionByName(new), some)
    )
    return docs.sparkSession.createDataFrame([], LEAK) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (with a ``text`` column) without the rows in which an item was found; nothing is shuffled."""

    def keep(index: Items, b: pa.RecordBatch) -> pa.RecordBatch:
        good = np.ones(b.num_rows, bool)
        for i, data, off in chunks(b.column("text")):
            good[[i + f[0] for f in index.find(data, off, threshold)]] = False
        return b.filter(pa.array(good))

    out = _held_against(docs, benchmark, radius, block_bytes, keep, docs.schema, lambda out, new, some: (new, new))
    return docs if out is None else out
