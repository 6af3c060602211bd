"""Near-duplicate lines by a deletion-neighbourhood join, one word edit apart at most; the earliest stays.

A line is the sequence of its lower-cased words. Two lines are near copies if they are equal, or, with ``min_words`` words or
more each, if one word replaced, inserted or deleted turns one into the other. A line is removed if an earlier line, by
(doc_id, hash of the text, line number), is a near copy of it.

Equal lines are found by a 128-bit hash. Every line of ``min_words`` words emits the hash of each variant with one word
deleted; equal variants meet. A variant's key names the words left and, for a replacement, the place of the deleted word, so
that equal keys are one edit apart; a key keeps the smallest line it has seen, so a hot line costs one row and never pairs.
Then the words of both lines are compared and the edit distance is verified; a line whose smallest candidate was a clash of
hashes is compared with all that share a key with it.
Only one occurrence of each line emits variants, and only if another line could match: of two lines one edit apart the
first or the last half is equal, so lines that share neither half with another line have no partner. That is decided by
a join of two keys a line, and reaches the second scan as a bit map (where that would be too large, by a join).

Defined cases: null text stays null; empty text and blank lines stay; a null doc_id comes after all others; rows that
share doc_id and text are one document, so none removes the other's lines, rows that share the doc_id only are documents of
their own, in the order of a hash of their texts; lines end at LF; an empty table gives an empty result; ``clean`` keeps
extra columns, ``removed_lines`` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import sieve, store
from rowloom.llm.words import U64, Words, chunks, mix, powers, prefix, spans

MIN_WORDS = 5
#: Bytes of lines that are worked on together; a longer line is a block of its own.
BLOCK = 1 << 18
PLACE = "nul boolean, d long, x long, line_no int"


class Lines:
    """Some lines: words, first and end word of each, number of words."""

    def __init__(self, data: np.ndarray, edge: np.ndarray):
        self.data, self.edge = data, edge
        self.words = Words(data, edge)
        self.begin, self.end = self.words.first[:-1], self.words.first[1:]
        self.n = self.end - self.begin
        self.p = prefix(self.words.hash)

    def text(self, i: int) -> bytes:
        """The words of line i with single spaces between them."""
        return b" ".join(self.data[self.edge[i] : self.edge[i + 1]].tobytes().split())

    def digests(self, at: np.ndarray) -> np.ndarray:
        """(lines, 2): a 128-bit hash of the words of the lines in ``at``."""
        raw = b"".join(blake2b(self.text(i), digest_size=16).digest() for i in at.tolist())
        return np.frombuffer(raw, np.int64).reshape(-1, 2)

    def halves(self) -> np.ndarray:
        """(lines, 4) keys: the first and last h words for h = step(n) and for h = step(n - 1)."""
        out = []
        for n in (self.n, self.n - 1):
            h = np.minimum(step(n), self.n)
            for side, (a, b) in enumerate(((self.begin, self.begin + h), (self.end - h, self.end))):
                out.append(mix(mix(spans(self.p, a, b) + h.astype(U64)) + U64(side)))
        return np.stack(out, axis=1)

    def variants(self, i: int) -> np.ndarray:
        """Keys of line i: n by the place of the replaced word, n with a word deleted (for the longer line), 1 for itself."""
        n, a, b = int(self.n[i]), int(self.begin[i]), int(self.end[i])
        at = np.arange(a, b)
        p = self.p
        # the words after the deleted one move one place down
        rest = spans(p, np.full(n, a), at) + (p[b] - p[at + 1]) * powers(len(p) + 1)[1][a + 1]
        left = mix(rest + U64(n - 1))
        whole = mix(spans(p, np.array([a]), np.array([b])) + U64(n))
        return np.concatenate([mix(left ^ mix((at - a + 1).astype(U64) * U64(2))), left, whole])


def step(n: np.ndarray) -> np.ndarray:
    """The largest of 1, 2, 3, 4, 6, 8, 12, 16, 24 ... up to n // 2: it rarely differs between n and n - 1."""
    half = np.maximum(n // 2, 1)
    top = 2 ** np.floor(np.log2(half)).astype(np.int64)
    return np.where(half >= top + top // 2, top + top // 2, top)


def blocks_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, Lines]]:
    """(index of the text, line number, lines) of blocks of whole lines."""
    for i, data, off in chunks(texts, BLOCK):
        edge = np.unique(np.r_[off, np.flatnonzero(data == 10) + 1])
        text = np.searchsorted(off, edge[:-1], "right") - 1
        number = np.arange(len(edge) - 1) - np.searchsorted(edge, off[:-1])[text] if len(text) else text
        a = 0
        while a < len(edge) - 1:
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + BLOCK, "right")) - 1)
            yield i + text[a:b], number[a:b], Lines(data[edge[a] : edge[b]], edge[a : b + 1] - edge[a])
            a = b


def _input(docs: DataFrame) -> DataFrame:
    d = store.columns(docs, "doc_id", "text")
    return d.select(F.col("doc_id").isNull().alias("nul"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("x"), "text")


def _scan(docs: DataFrame, min_words: int) -> DataFrame:
    """(nul, d, x, line_no, h, g, k0 .. k3) of every line that has a word; lines of fewer than min_words words have no keys."""
    names = ["nul", "d", "x", "line_no", "h", "g", "k0", "k1", "k2", "k3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, number, x in blocks_of(b.column("text")):
                at = np.flatnonzero(x.n)
                keys = x.halves()[at].view(np.int64)
                short = x.n[at] < min_words
                digest = x.digests(at)
                cols = [b.column(c).take(pa.array(text[at])) for c in names[:3]]
                cols += [pa.array(number[at].astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
                cols += [pa.array(keys[:, k], mask=short if k < 2 else short | (keys[:, k] == keys[:, k - 2])) for k in range(4)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return _input(docs).mapInArrow(run, f"{PLACE}, h long, g long, k0 long, k1 long, k2 long, k3 long")


def place(h: np.ndarray, d: np.ndarray, x: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One long for a line and its position."""
    u = lambda v: v.astype(np.int64).view(U64)
    return mix(u(h) ^ mix(u(d) * U64(31) + u(line)) ^ mix(u(x) + U64(7))).view(np.int64)


def _long(c: pa.Array) -> np.ndarray:
    return c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _pick(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """``suspects``: (nul, d, x, line_no, h). The same rows with ord, a number in their order, and line, the words."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(*(_long(b.column(c)) for c in ("h", "d", "x", "line_no"))))], ["key"])

    found = sieve.broadcast(docs.sparkSession, suspects.select("h", "d", "x", "line_no").mapInArrow(places, "key long"))
    names = ["nul", "d", "x", "line_no", "h", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, number, x in blocks_of(b.column("text")):
                at = np.flatnonzero(x.n)
                own = [b.column(c).take(pa.array(text[at])) for c in names[:3]]
                h = x.digests(at)[:, 0]
                hit = np.ones(len(at), bool) if found is None else sieve.among(place(h, _long(own[1]), _long(own[2]), number[at]), found.value)
                cols = [c.filter(pa.array(hit)) for c in own]
                cols += [pa.array(number[at][hit].astype(np.int32)), pa.array(h[hit]), pa.array([x.text(i).decode() for i in at[hit].tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = _input(docs).mapInArrow(run, f"{PLACE}, h long, line string").dropDuplicates(names[:5])
    on = F.col("r.nul").eqNullSafe(F.col("s.nul")) & F.col("r.d").eqNullSafe(F.col("s.d"))
    for c in ("x", "line_no", "h"):
        on = on & (F.col(f"r.{c}") == F.col(f"s.{c}"))
    rows = rows.alias("r").join(suspects.alias("s"), on, "left_semi")
    out = store.keep(rows.orderBy("nul", "d", "x", "line_no").withColumn("ord", F.monotonically_increasing_id()), "line-picked")
    sieve.destroy(found)
    return out


def _emit(picked: DataFrame) -> DataFrame:
    """(key, kind, ord): kind 0 a replaced word, 1 a deleted word, 2 the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ord").to_numpy()
            for i, data, off in chunks(b.column("line"), BLOCK, lower=False):
                x = Lines(data, off)
                out, size = [], 0
                for k in range(len(x.n)):
                    out.append(x.variants(k))
                    size += len(out[-1])
                    if size > 1 << 17 or k == len(x.n) - 1:
                        yield _batch(x.n[k + 1 - len(out) : k + 1], ids[i + k + 1 - len(out) : i + k + 1], out)
                        out, size = [], 0

    return picked.select("ord", "line").mapInArrow(run, "key long, kind byte, ord long")


def _batch(n: np.ndarray, ids: np.ndarray, out: list[np.ndarray]) -> pa.RecordBatch:
    size = 2 * n + 1
    k = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
    kind = (at >= n[k]).astype(np.int8) + (at >= 2 * n[k])
    cols = [np.concatenate(out).view(np.int64), kind.astype(np.int8), ids[k]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "kind", "ord"])


def one_edit(a: Column, b: Column) -> Column:
    """Whether one word replaced, inserted or deleted, or none, turns the words of a into those of b (words, a space between)."""
    pair = F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b"))
    longer = lambda p: F.when(F.size(p["a"]) > F.size(p["b"]), F.struct(p["a"].alias("l"), p["b"].alias("s"))).otherwise(F.struct(p["b"].alias("l"), p["a"].alias("s")))

    def check(q: Column) -> Column:
        n = F.size(q["s"])
        same = F.zip_with(F.slice(q["l"], 1, n), q["s"], lambda x, y: x.eqNullSafe(y))
        at = F.array_position(same, False).cast("int")
        skip = F.when(at == 0, n).otherwise(at - 1)
        shifted = F.slice(q["l"], skip + 2, n - skip) == F.slice(q["s"], skip + 1, n - skip)
        replaced = F.size(F.filter(same, lambda x: ~x)) <= 1
        return F.when(F.size(q["l"]) == n, replaced).when(F.size(q["l"]) == n + 1, shifted).otherwise(False)

    return F.transform(F.transform(F.array(pair), longer), check)[0]


def _verified(pairs: DataFrame, picked: DataFrame) -> DataFrame:
    """``pairs`` (ord, near) with ok: whether the lines are one edit apart."""
    a, b = picked.select("ord", F.col("line").alias("a")), picked.select(F.col("ord").alias("near"), F.col("line").alias("b"))
    return pairs.join(a, "ord").join(b, "near").select("ord", "near", one_edit(F.col("a"), F.col("b")).alias("ok"))


def _nearest(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """(ord, near): the earliest near copy, before it, of each line that has one; ``rows``: the variants."""
    least = rows.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("ord"))).alias(f"m{k}") for k in range(3)])
    # a replaced word meets its like, a deleted word the whole shorter line, a whole line the deleted words
    like = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    seen = rows.join(least, "key").select("ord", like.alias("near")).filter("near < ord")
    near = store.keep(_verified(seen.groupBy("ord").agg(F.min("near").alias("near")), picked), "line-near")
    out, clash = near.filter("ok").select("ord", "near"), near.filter("not ok").select("ord")
    if not clash.limit(1).count():
        return out
    # the smallest candidate was a clash of hashes: all that share a key
    own = rows.join(clash, "ord", "left_semi")
    other = rows.select("key", F.col("ord").alias("near"), F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind")).cast("byte").alias("kind"))
    every = own.join(other, ["key", "kind"]).filter("near < ord").select("ord", "near").distinct()
    return out.unionByName(_verified(every, picked).filter("ok").groupBy("ord").agg(F.min("near").alias("near")))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, x, line_no, kept_doc_id, kept_line_no): the lines to remove and the earliest near copy of each; x is
    xxhash64 of the text, line_no counts from 0."""
    store.small_batches(docs.sparkSession)
    lines = store.keep(_scan(docs, min_words), "lines")
    at = F.struct("nul", "d", "x", "line_no")
    ones = store.keep(
        lines.groupBy("h", "g").agg(F.min(at).alias("first"), F.max(at).alias("last"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)]), "line-classes"
    )
    keys = ones.select("h", F.explode(F.array_compact(F.array("k0", "k1", "k2", "k3"))).alias("k"))
    shared = keys.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("k")
    suspects = keys.join(shared, "k", "left_semi").select("h").distinct()
    suspects = store.keep(ones.join(suspects, "h", "left_semi").select("first.*", "h"), "line-suspects")
    picked = _pick(docs, suspects)
    rows = store.keep(_emit(picked), "line-variants")
    near = _nearest(rows, picked)
    to = picked.select(F.col("ord").alias("near"), at.alias("kept"))
    near = picked.select("ord", "h", at.alias("first")).join(near, "ord").join(to, "near").select("h", "first", "kept")
    kept = F.coalesce("kept", "first")
    best = ones.select("h", "g", "first", "last").join(near, ["h", "first"], "left").filter("kept is not null or first <> last").select("h", "g", kept.alias("kept"))
    out = lines.join(best, ["h", "g"]).filter(~at.eqNullSafe(F.col("kept")))
    return out.select(F.col("d").alias("doc_id"), "x", "line_no", F.col("kept.d").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")).distinct()


def per_document(removed: DataFrame) -> DataFrame:
    return removed.groupBy("doc_id", "x").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _beside(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with __gone, the numbers of the lines to remove, or null."""
    gone = per_document(removed).select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), F.col("removed").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__x"]), "left")


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; all columns and rows stay."""
    joined = _beside(docs, removed_lines(docs, min_words))
    lines = F.array(F.split("text", "\n", -1))
    kept = F.transform(lines, lambda z: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(z) - 1), F.col("__gone")), lambda i: z[i]), "\n"))[0]
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): per row of ``docs`` its lines and the numbers of those removed."""
    n = F.expr("case when text is null then 0 else length(text) - length(replace(text, '\n', '')) + 1 end").cast("long")
    gone = per_document(removed_lines(docs, min_words)).withColumnsRenamed({"doc_id": "__id", "x": "__x"})
    d = store.columns(docs, "doc_id", "text").select("doc_id", n.alias("n_lines"), F.xxhash64("text").alias("x"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    joined = d.join(gone, d["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (d["x"] == gone["__x"]), "left")
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
