"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are linked when at most ``radius`` of 64 bits differ. Correlated bits are grouped into partitions;
a dynamic program allots partition i a threshold t_i >= -1 with sum(t_i) = radius - partitions + 1, so that any two
linked fingerprints differ by at most t_i bits in some partition i. Of all allotments that deal out at most ``ROWS`` rows a
fingerprint, whatever the size of the corpus, it takes the one with the fewest estimated candidates; the
estimate is the distribution of distances inside each block of four bits, from counts over all fingerprints.
Fingerprints are dealt out by partition value, look into the buckets of the larger values within t_i, and are verified
there; buckets return spanning edges, so a group of n near copies costs n rows and not n * n.

``keep_one`` is the filter for documents of a shingle similarity: a pair of similarity 0.8 differs in about 10 of 64 bits,
further than a pigeonhole can look. It takes ``rounds`` fingerprints by independent hashes and links documents within
``radius`` in any of them; it also links documents that share one of ``BANDS`` min-wise keys of ``BAND`` hashes each, which
a pair of similarity s misses with probability (1 - s ** BAND) ** BANDS: 0.04% at 0.8. A link counts only if at most
``FAR`` of 256 SimHash bits differ (about 39 do at 0.8, with a spread of 6). The members of a group are verified by
their exact Jaccard similarity to the smallest; those unlike it are a group again, until no two that are alike stay.

Defined cases: null and empty texts have fingerprint zero, linked like any other; repeated rows are rows of their own
with the same component; a null doc_id takes the component of its fingerprint (null if no row with an id has it);
an empty table gives an empty result; extra columns are ignored. ``keep_one`` tells rows apart by doc_id and text, so
rows that share a doc_id but not the text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import buckets, sieve, store
from rowloom.llm.components import connected_components
from rowloom.llm.words import SPACE, Words, chunks, mix, shingles

BITS, BLOCK = 64, 4
#: Members or lookers that a bucket's cell holds at most.
MOST = 8192
#: Rows that a fingerprint is dealt out to at most, whatever the size of the corpus.
ROWS = 32


def fingerprint(text: bytes, k: int = 4) -> int:
    """64-bit SimHash of one lower-cased text's k-word shingles by XXH64, seed 42; bit set if set in over half of them."""
    words = text.split()
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - k + 1].tolist()
    end = end[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), 1 << 16):
        part = slice(at, at + (1 << 16))
        h = np.array([digest(line[s:e], 42) for s, e in zip(start[part], end[part], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(start), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint((t or "").encode().lower(), k) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return store.columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _counts(fps: DataFrame, of, size: int) -> np.ndarray:
    """Sums over all fingerprints (fp) of each round (r) of an array of ``size`` numbers; only those sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            r, fp = b.column("r").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            for k in np.unique(r).tolist():
                total[k] = total.get(k, 0) + of(fp[r == k], k)
        for k, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(t[at])], ["r", "at", "n"])

    out = np.zeros((ROUNDS, size), np.int64)
    for x in fps.select("r", "fp").mapInArrow(run, "r int, at long, n long").groupBy("r", "at").agg(F.sum("n").alias("n")).collect():
        out[x.r, x.at] = x.n
    return out


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def correlated_blocks(n: int, both: np.ndarray) -> list[list[int]]:
    """Blocks of ``BLOCK`` bits, each grown greedily around correlated bits, in an order in which correlated blocks are
    neighbours. both: how often bits i and j are both set."""
    p = both / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    r = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, out = set(range(BITS)), []
    while left:
        members = sorted(left)
        last = out[-1] if out else members
        block = [max(members, key=lambda b: (r[b, last].sum(), -b))]
        left.discard(block[0])
        while len(block) < BLOCK:
            block.append(max(sorted(left), key=lambda b: r[b, block].sum()))
            left.discard(block[-1])
        out.append(block)
    return out


def distances(counts: np.ndarray) -> np.ndarray:
    """P(two rows differ in d bits of a block), from the counts of its values: an autocorrelation under XOR."""
    f = counts / max(counts.sum(), 1)
    v = np.arange(1 << BLOCK)
    weight = np.bitwise_count(v)
    meet = np.array([(f * f[v ^ x]).sum() for x in v])
    return np.bincount(weight, weights=meet, minlength=BLOCK + 1)


def probes(width: int, t: int) -> float:
    """Rows of a fingerprint in a partition: its own bucket and the larger values within t bits, half of all on average."""
    return (1 + sum(comb(width, d) for d in range(t + 1))) / 2


def allot(blocks: list[list[int]], near: list[np.ndarray], radius: int, rows: int = ROWS) -> list[tuple[list[int], int]]:
    """Partitions (bits, threshold >= 0) with the fewest estimated candidates of those that deal out at most ``rows`` rows;
    partitions with threshold -1 are left out.

    The thresholds must add up to radius - partitions + 1, that is t + 1 over all partitions to radius + 1, so one table
    over (blocks used, sum of t + 1, rows in halves) serves any number of partitions: runs of blocks, each with its threshold.
    A radius that no allotment of so many rows reaches gets twice as many.
    """
    end, most = len(blocks), 2 * rows
    table: list[dict[tuple[int, int], tuple[float, tuple]]] = [{} for _ in range(end + 1)]
    table[0][0, 0] = (0.0, ())
    for a in range(end):
        d = np.ones(1)
        for b in range(a + 1, end + 1):
            d = np.convolve(d, near[b - 1])
            bits = sum(blocks[a:b], [])
            for t in range(-1, radius + 1):
                more = 0 if t < 0 else int(2 * probes(len(bits), t))
                if more > most:
                    break
                c = 0.0 if t < 0 else float(d[: t + 1].sum())
                for (used, dealt), (cost, parts) in table[a].items():
                    to = (used + t + 1, dealt + more)
                    if to[0] <= radius + 1 and to[1] <= most and (to not in table[b] or cost + c < table[b][to][0]):
                        table[b][to] = (cost + c, (*parts, (bits, t)))
    done = [(cost, dealt, parts) for (used, dealt), (cost, parts) in table[end].items() if used == radius + 1]
    if not done:
        return allot(blocks, near, radius, 2 * rows)
    return [(bits, t) for bits, t in min(done)[2] if t >= 0]


def plan(fps: DataFrame, radius: int) -> dict[int, list[tuple[list[int], int]]]:
    """The partitions of each round r of ``fps`` (r, fp)."""

    def both(fp: np.ndarray, _: int) -> np.ndarray:
        b = _bits(fp).astype(np.float32)
        return (b.T @ b).astype(np.int64).ravel()

    n = {x.r: x.n for x in fps.groupBy("r").agg(F.count("*").alias("n")).collect()}
    pair = _counts(fps, both, BITS * BITS).reshape(ROUNDS, BITS, BITS)
    blocks = {r: correlated_blocks(k, pair[r]) for r, k in n.items()}

    def values(fp: np.ndarray, r: int) -> np.ndarray:
        return np.concatenate([np.bincount(gather(fp, b).astype(np.int64), minlength=1 << BLOCK) for b in blocks[r]])

    hist = _counts(fps, values, (BITS // BLOCK) << BLOCK).reshape(ROUNDS, -1, 1 << BLOCK)
    return {r: allot(b, [distances(h) for h in hist[r]], radius) for r, b in blocks.items()}


def _masks(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in c) for d in range(1, t + 1) for c in combinations(range(width), d)]


def links(reps: DataFrame, radius: int = 4, most: int = MOST) -> DataFrame:
    """``reps``: (r, fp, rep), one row per fingerprint of a round. Spanning edges (a, b) over rep of the graph of fingerprints
    of one round at most ``radius`` bits apart; all rounds are dealt out at once."""
    parts = plan(reps, radius)

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                s = b.slice(at, 1 << 14)
                r = s.column("r").to_numpy()
                for k in np.unique(r).tolist():
                    yield k, s.filter(pa.array(r == k))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, s in rounds(batches):
            fp, rep = s.column("fp").to_numpy(), s.column("rep").to_numpy()
            for i, (bits, t) in enumerate(parts[k]):
                own = gather(fp.view(np.uint64), bits)
                for mask in [0, *_masks(len(bits), t)]:
                    to = own ^ np.uint64(mask)
                    pick = slice(None) if not mask else to > own
                    key = buckets_key(to[pick], k << 6 | i)
                    role = np.full(len(key), int(mask > 0), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, role, fp[pick], rep[pick])], ["key", "role", "fp", "rep"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, s in rounds(batches):
            fp = s.column("fp").to_numpy().view(np.uint64)
            for i, (bits, _) in enumerate(parts[k]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k << 6 | i, np.int32)), pa.array(gather(fp, bits).view(np.int64))], ["part", "value"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, value, n = (b.column(c).to_numpy() for c in ("part", "value", "n"))
            for k in np.unique(part).tolist():
                own, m = value[part == k].view(np.uint64), n[part == k]
                bits, t = parts[k >> 6][k & 63]
                for mask in [0, *_masks(len(bits), t)]:
                    to = own ^ np.uint64(mask)
                    pick = slice(None) if not mask else to > own
                    key, none = buckets_key(to[pick], k), np.zeros(len(m[pick]), np.int64)
                    cols = [key, none if mask else m, m[pick] if mask else none]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "n", "lookers"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buckets.whole_groups(batches):
            fp, rep = buckets.column(t, "fp").view(np.uint64), buckets.column(t, "rep")
            forest = buckets.Forest(len(fp))
            for a, b in buckets.pairs(*buckets.ranges(t)):
                near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
                forest.union(a[near], b[near])
            a, b = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    dealt = reps.select("r", "fp", "rep").mapInArrow(deal, "key long, role int, fp long, rep long")
    sizes = reps.select("r", "fp").mapInArrow(members, "part int, value long").groupBy("part", "value").agg(F.count("*").alias("n"))
    # buckets of fewer members can't send more lookers than a cell holds
    large = sizes.filter(F.col("n") > most // 128).mapInArrow(spread, "key long, n long, lookers long")
    large = large.groupBy("key").agg(F.sum("n").alias("n"), F.sum("lookers").alias("lookers"))
    return buckets.grid(dealt, large, most, "fp").mapInArrow(meet, "a long, b long").filter("a <> b").distinct()


def buckets_key(value: np.ndarray, part: int) -> np.ndarray:
    """One long for a partition and its value; the bits are mixed, as a meeting is verified anyway."""
    return mix(value ^ mix(np.array([part + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4, most: int = MOST) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of ``docs`` (doc_id, text)."""
    store.small_batches(docs.sparkSession)
    fps = store.keep(fingerprints(docs, k), "simhash-fp")
    reps = store.keep(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-rep")
    parts = connected_components(links(reps.withColumn("r", F.lit(0)), radius, most))
    named = reps.join(parts, reps.rep == parts.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


#: Independent SimHashes of a document, of which the first ``rounds`` are searched and all tell whether a link can be true.
ROUNDS = 4
SALTS = [0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(ROUNDS)]
#: Bits of ROUNDS * 64 that two documents of a link may differ in.
FAR = 62
#: Min-wise keys of a document, and hashes that a key takes together.
BANDS, BAND = 20, 5
#: Shingles of a group that one task holds, members of a group that one cell compares with a block of kept ones.
ELEMENTS, CELL = 1 << 22, 8192


def _pieces(first: np.ndarray, n: int, piece: int = 1 << 16) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Pieces of n shingles: those in it, the texts they are of, and where each text's begin in it."""
    for a in range(0, n, piece):
        b = min(a + piece, n)
        i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
        yield slice(a, b), slice(i, j), np.maximum(first[i:j], a) - a


def band_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys: per band a hash of its number and of the least shingle hash of each text by BAND hashes."""
    salts = [mix(np.array([0xD1B54A32D192ED03 * (i + 1) & (1 << 64) - 1], np.uint64)) for i in range(BANDS * BAND)]
    least = np.full((BANDS * BAND, len(first)), (1 << 64) - 1, np.uint64)
    for part, texts, at in _pieces(first, len(h)):
        for i, salt in enumerate(salts):
            least[i, texts] = np.minimum(least[i, texts], np.minimum.reduceat(mix(h[part] ^ salt), at))
    out = np.zeros((len(first), BANDS), np.uint64)
    for i in range(BANDS):
        key = np.full(len(first), i + 1, np.uint64)
        for j in range(BAND):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ least[i * BAND + j])
        out[:, i] = key
    return out


def place_of() -> list[Column]:
    """A row of documents is told by its doc_id and a hash of its text; equal rows are one."""
    return [F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("x")]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(d, x, th, f0 .. f3, bands) of ``docs`` (d, x, text): th is a hash of the words, each f a SimHash of the shingles by another hash."""
    names = ["d", "x", "th", *[f"f{i}" for i in range(ROUNDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, off in chunks(b.column("text")):
                w = Words(data, off)
                size = np.diff(w.first)
                h, first = shingles_of(w, k)
                cols = [b.column("d").slice(i, len(size)), b.column("x").slice(i, len(size)), pa.array(words_digest(data, off))]
                n = np.diff(np.r_[first, len(h)])
                for r in range(ROUNDS):
                    fp = np.packbits(ones_of(mix(h ^ np.uint64(SALTS[r])), first) * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
                    cols.append(pa.array(np.where(size > 0, fp, 0).view(np.int64)))
                keys = pa.array(band_keys(h, first).view(np.int64).ravel())
                cols.append(pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), keys))
                yield pa.RecordBatch.from_arrays(cols, [*names, "bands"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", bands array<long>")


def words_digest(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the words of each text, as long; long texts are read in pieces that end with a word."""
    out = []
    for a, b in pairwise(offsets.tolist()):
        h, joint = blake2b(digest_size=8), b""
        while a < b:
            end = min(a + piece, b)
            while end < b and not SPACE[data[end]]:
                gap = np.flatnonzero(SPACE[data[end : min(end + 256, b)]])
                end = end + int(gap[0]) if len(gap) else min(end + 256, b)
            words = b" ".join(data[a:end].tobytes().split())
            if words:
                h.update(joint + words)
                joint = b" "
            a = end
        out.append(int.from_bytes(h.digest(), "little", signed=True))
    return np.array(out, np.int64)


def ones_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 64): how often each bit is set among the hashes of each text."""
    out = np.zeros((len(first), BITS), np.int64)
    for part, texts, at in _pieces(first, len(h)):
        out[texts] += np.add.reduceat(_bits(h[part]), at, axis=0, dtype=np.int64)
    return out


def shingles_of(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where each text's begin. A text of fewer than k words has one shingle, one
    without words a zero."""
    size = np.diff(w.first)
    count = np.maximum(size - k + 1, 1)
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for n in range(1, min(k, int(size.max(initial=0)) + 1)):
        own = size == n
        out[first[own]] = shingles(w, n, w.first[:-1][own])
    whole = shingles(w, k)
    if len(whole):
        # words that begin a shingle: all of the longer texts' but the last k - 1 of each
        long = size >= k
        begins = np.repeat(long, size)
        for j in range(1, k):
            begins[w.first[1:][long] - j] = False
        out[np.repeat(long, count)] = whole[begins[: len(whole)]]
    return out, first


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 6, rounds: int = 2, most: int = MOST, elements: int = ELEMENTS) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    A document goes if its words equal, or its shingles' Jaccard similarity is at least ``similarity`` to, those of a
    smaller one of its group that stays. Of equal rows that are kept all but one go; rows with a null doc_id stay.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    placed = store.columns(docs, "doc_id", "text").select(*place_of(), "text").filter("d is not null")
    sig = store.keep(signatures(placed, k), "simhash-sig")
    fs = [f"f{i}" for i in range(ROUNDS)]
    place = F.struct("d", "x")
    classes = store.keep(
        sig.groupBy("th").agg(F.min(place).alias("place"), F.count("*").alias("n"), *[F.min(f).alias(f) for f in [*fs, "bands"]]), "simhash-class"
    )
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.col(f).alias("fp")) for i, f in enumerate(fs[:rounds])]))
    own = classes.select("th", each.alias("e")).select("e.r", "e.fp", "th")
    reps = store.keep(own.groupBy("r", "fp").agg(F.min("th").alias("rep")), "simhash-rep")
    same = own.join(reps, ["r", "fp"]).select(F.col("th").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    edges = _not_far(links(reps, radius, most).unionByName(same).distinct(), classes, fs)
    edges = store.keep(edges.unionByName(_band_links(classes, fs, most)).distinct(), "simhash-edges")
    parts = connected_components(edges).join(classes.select(F.col("th").alias("id"), "place"), "id").select("id", "component", "place.d", "place.x")
    parts = store.keep(parts, "simhash-parts")
    # shingle sets of the groups' members, a row each
    found = sieve.broadcast(spark, parts.select(F.col("d").alias("key")))
    wanted = sieve.rows_in(placed, found, True, "d").dropDuplicates(["d", "x"]).join(parts.select("d", "x", "id"), ["d", "x"]).select("id", "text")
    sets = store.keep(_shingle_sets(wanted, k), "simhash-sets")
    sieve.destroy(found)
    near = _near_kept(parts, sets, similarity, elements)
    # copies of a class go with its smallest row, all but one row of those that stay
    fate = classes.join(near, classes.th == near.id, "left").select("th", "place", "n", F.col("id").isNotNull().alias("gone")).filter("gone or n > 1")
    out = sig.select("d", "x", "th").join(fate, "th").select("d", "x", (F.col("gone") | (place != F.col("place"))).alias("gone"), "n")
    twice = sig.groupBy("d", "x").agg(F.count("*").alias("c")).filter("c > 1").select("d", "x")
    out = store.keep(out.filter("gone").select("d", "x").distinct(), "simhash-gone")
    left = sieve.without(docs, out, place_of())
    if twice.limit(1).count():
        left = _one_of_repeated(left, store.keep(twice, "simhash-twice"))
    return left


def _far(a: list[Column], b: list[Column]) -> Column:
    """Bits in which the SimHashes in columns a and b differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _not_far(edges: DataFrame, classes: DataFrame, fs: list[str]) -> DataFrame:
    """The edges (a, b) whose ends differ in at most FAR bits."""
    one = classes.select(F.col("th").alias("a"), F.array(*fs).alias("fa"))
    two = classes.select(F.col("th").alias("b"), F.array(*fs).alias("fb"))
    fa, fb = ([F.col(c)[i] for i in range(ROUNDS)] for c in ("fa", "fb"))
    return edges.join(one, "a").join(two, "b").filter(_far(fa, fb) <= FAR).select("a", "b")


def _band_links(classes: DataFrame, fs: list[str], most: int) -> DataFrame:
    """Spanning edges (a, b), in each min-wise key's bucket, of the classes that differ in at most FAR bits."""
    keys = classes.select("th", F.explode("bands").alias("key"))
    sizes = store.keep(keys.groupBy("key").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("lookers")).filter("n > 1"), "simhash-keys")
    rows = keys.join(sizes.select("key"), "key", "left_semi").join(classes.select("th", *fs), "th")
    rows = rows.select("key", F.lit(0).alias("role"), F.col("th").alias("rep"), *fs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buckets.whole_groups(batches):
            rep, f = buckets.column(t, "rep"), [buckets.column(t, c).view(np.uint64) for c in fs]
            forest = buckets.Forest(len(rep))
            for a, b in buckets.pairs(*buckets.ranges(t), 1 << 19):
                far = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int16) for x in f)
                forest.union(a[far <= FAR], b[far <= FAR])
            a, b = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return buckets.grid(rows, sizes, most, "rep").mapInArrow(meet, "a long, b long").filter("a <> b").distinct()


def _near_kept(parts: DataFrame, sets: DataFrame, similarity: float, elements: int = ELEMENTS, block: int = 64) -> DataFrame:
    """``parts``: (id, component, d, x), ``sets``: (id, n, s). (id) of the members alike to a smaller one, by (d, x), of their
    component that stays.

    A component of up to ``elements`` shingles is finished inside a task. Of a larger one the smallest ``block`` members
    are; then cells of its other members meet those of them that stay, and the rest is a group again, with a block twice as large.
    """
    rest = store.keep(parts.join(sets.select("id", "n"), "id"), "simhash-rest")
    out = None
    while True:
        groups = rest.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("m")).filter("m > 1")
        small = rest.join(groups.filter(F.col("total") <= elements), "component").select(*parts.columns)
        near = store.keep(_near_in_groups(small.withColumn("i", F.lit(0)).withColumn("role", F.lit(0)), sets, similarity), "simhash-near")
        out = near if out is None else out.unionByName(near)
        cells = F.greatest(F.ceil(F.col("total") / elements), F.ceil(F.col("m") / CELL)).cast("int").alias("cells")
        rest = store.keep(rest.join(groups.filter(F.col("total") > elements).select("component", cells), "component"), "simhash-rest")
        if not rest.limit(1).count():
            return out
        # the smallest of each cell's smallest
        cell = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
        rest = rest.withColumn("i", cell)
        first = rest.withColumn("at", F.row_number().over(Window.partitionBy("component", "i").orderBy("d", "x"))).filter(F.col("at") <= block)
        first = first.withColumn("at", F.row_number().over(Window.partitionBy("component").orderBy("d", "x"))).filter(F.col("at") <= block)
        first = store.keep(first.select(*parts.columns, "cells"), "simhash-first")
        near = store.keep(_near_in_groups(first.select(*parts.columns, F.lit(0).alias("i"), F.lit(0).alias("role")), sets, similarity), "simhash-near")
        out = out.unionByName(near)
        stay = first.join(near, "id", "left_anti")
        stay = stay.select(*parts.columns, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("i"), F.lit(0).alias("role"))
        others = rest.join(first.select("id"), "id", "left_anti")
        both = stay.unionByName(others.select(*parts.columns, "i", F.lit(1).alias("role")))
        near = store.keep(_near_in_groups(both, sets, similarity), "simhash-near")
        out = out.unionByName(near)
        rest = store.keep(others.join(near, "id", "left_anti").select(*parts.columns, "n"), "simhash-rest")
        block = min(2 * block, CELL // 2)


def _near_in_groups(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``rows``: (id, component, d, x, i, role), a group for each (component, i). (id) of the rows alike to an earlier row of
    role 0 that is alike to none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buckets.whole_groups(batches, 256):
            key, i, ids, role = (buckets.column(t, c) for c in ("key", "i", "id", "role"))
            s = t.column("s").combine_chunks()
            at, h = s.offsets.to_numpy(), s.values.to_numpy()
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1])])
            for a, b in zip(cut, np.r_[cut[1:], len(key)], strict=True):
                gone = alike_to_kept(h[at[a] : at[b]], at[a : b + 1] - at[a], similarity, int((role[a:b] == 0).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][gone])], ["id"])

    rows = rows.select("id", F.col("component").alias("key"), "i", F.lit(0).alias("j"), "role", "d", "x").join(sets.select("id", "s"), "id")
    return rows.repartition("key", "i").sortWithinPartitions("key", "i", "j", "role", "d", "x").mapInArrow(run, "id long")


def alike_to_kept(h: np.ndarray, at: np.ndarray, similarity: float, first: int | None = None) -> np.ndarray:
    """Which of the sets h[at[i]:at[i + 1]] are alike to an earlier one, of the ``first`` (all by default), that is not; by
    postings of each element."""
    size = np.diff(at)
    _, code = np.unique(h, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(len(size)), size)[order]
    post = np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
    gone = np.zeros(len(size), bool)
    for i in range(len(size) if first is None else first):
        if gone[i]:
            continue
        own = code[at[i] : at[i + 1]]
        both = np.zeros(len(size), np.int64)
        for a in range(0, len(own), 1 << 10):
            part = own[a : a + (1 << 10)]
            n = post[part + 1] - post[part]
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(post[part], n)
            both += np.bincount(owner[where], minlength=len(size))
        near = both >= similarity * (size[i] + size - both)
        gone |= near & (np.arange(len(size)) > i)
    return gone


def _one_of_repeated(docs: DataFrame, twice: DataFrame) -> DataFrame:
    found = sieve.broadcast(docs.sparkSession, twice.select(F.col("d").alias("key")))
    rest = sieve.rows_in(docs, found, True, "doc_id").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *place_of())
    both = rest.join(twice.withColumn("again", F.lit(True)), ["d", "x"], "left")
    one = both.filter("again").dropDuplicates(["d", "x"]).unionByName(both.filter("again is null")).select("row.*")
    return sieve.rows_in(docs, found, False, "doc_id").unionByName(one)


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, s): the distinct shingle hashes of each of ``docs`` (id, text), and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, off in chunks(b.column("text")):
                h, first = shingles_of(Words(data, off), k)
                sets = [np.unique(x).view(np.int64) for x in np.split(h, first[1:])]
                cols = [b.column("id").slice(i, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "s"])

    return docs.mapInArrow(run, "id long, n long, s array<long>")
