"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

A rotation of the principal axes is learnt on a bounded sample so that sign codes are balanced and lose little; every
vector is indexed under each of ``tables`` substrings of its 64-bit code (together with its label). Codes meet first, and only
vectors whose code has another within ``FAR`` bits in a table are fetched, to be compared there by cosine in double precision (at
0.98 about 4 bits differ, with a spread of 2). A pair counts in the first table in which it meets, so
links are counted without a list of pairs; buckets return counts and spanning edges. Exact copies are one class.

Defined cases: a null label, and a null, empty or zero vector or one with null or non-finite components, links with
nothing; vectors of different lengths don't link; rows that share a vec_id add up under that id; a null vec_id is never
a class's name and gets no links; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import buckets, store
from rowloom.llm.components import connected_components

BITS = 64
TABLES = 6
#: Vectors that the rotation is fitted on, those with the smallest hash of their id.
SAMPLE = 8192
MOST = 2048
#: Bits in which the codes of a pair may differ.
FAR = 16


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection d x bits) by iterative quantisation; a short vector's missing bits are random directions."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    b = min(bits, d)
    v = x - mean
    _, axes = np.linalg.eigh(v.T @ v)
    axes = axes[:, ::-1][:, :b]
    v = v @ axes
    r = np.linalg.qr(rng.standard_normal((b, b)))[0]
    for _ in range(rounds if len(x) > 1 else 0):
        code = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        r = (u @ w).T
    out = axes @ r
    return mean, np.hstack([out, rng.standard_normal((d, bits - b))]) if b < bits else out


def substrings(tables: int) -> list[int]:
    """Masks of ``tables`` runs of bits that make up the code."""
    edge = [BITS * i // tables for i in range(tables + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    bit = ((x - model[0]) @ model[1]) >= 0
    return np.packbits(bit, axis=1, bitorder="little").view(np.uint64).ravel()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """``vectors``: (vec_id, embedding, label). One row per input row: (vec_id, n_links, component_id, kept)."""
    v = store.columns(vectors, "vec_id", "embedding", "label")
    if "double" not in v.schema["embedding"].dataType.simpleString():
        v = v.withColumn("embedding", F.col("embedding").cast("array<float>"))
    fine = F.expr(
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    )
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    v = v.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    good = v.filter("fine")
    same = ["label", "h1", "h2"]
    classes = store.keep(
        good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.min_by("embedding", "vec_id").alias("embedding")),
        "itq-class",
    )
    models = _models(classes, sample)
    masks = substrings(tables)

    name = ["rep", "label", "h1", "h2"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                size = np.diff(np.asarray(b.column("embedding").offsets))
                flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
                start = np.r_[0, np.cumsum(size)]
                for d in np.unique(size).tolist():
                    row = np.flatnonzero(size == d)
                    x = unit(flat[start[row][:, None] + np.arange(d)].astype(np.float64))
                    code = codes(x, models.get(d) or learn_rotation(np.zeros((0, d))))
                    s = b.take(pa.array(row))
                    cols = [*(s.column(c) for c in name), s.column("m"), pa.array(np.full(len(row), d, np.int32)), pa.array(code.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, [*name, "m", "d", "code"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rowloom.llm.words import mix

        for b in batches:
            code = b.column("code").to_numpy().view(np.uint64)
            label, d = (b.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("label", "d"))
            for k, mask in enumerate(masks):
                key = mix(mix((code & np.uint64(mask)) + np.uint64(k)) ^ mix(label * np.uint64(8191) + d))
                cols = [pa.array(key.view(np.int64)), pa.array(np.zeros(len(key), np.int32)), pa.array(np.full(len(key), k, np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *b.columns], ["key", "role", "tab", *b.schema.names])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buckets.whole_groups(batches):
            code, label, d = (buckets.column(t, c) for c in ("code", "label", "d"))
            hit = np.zeros(t.num_rows, bool)
            for a, b in buckets.pairs(*buckets.ranges(t)):
                ok = (np.bitwise_count(code.view(np.uint64)[a] ^ code.view(np.uint64)[b]) <= FAR) & (label[a] == label[b]) & (d[a] == d[b])
                hit[a[ok]] = hit[b[ok]] = True
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in buckets.whole_groups(batches, 1 << 14):
            size = t.column("d").to_numpy()
            for d in np.unique(size).tolist():
                yield _verify(t.take(pa.array(np.flatnonzero(size == d))), masks, threshold)

    coded = classes.select("rep", F.col("label").cast("long").alias("label"), "h1", "h2", "m", "embedding")
    fields = "rep long, label long, h1 long, h2 long, m long, d int, code long"
    rows = store.keep(coded.mapInArrow(encode, fields), "itq-codes").mapInArrow(deal, f"key long, role int, tab int, {fields}")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("lookers"))
    cells = buckets.grid(rows, sizes, most, "rep, h1")
    some = store.keep(cells.mapInArrow(near, cells.schema), "itq-near")
    some = some.join(coded.select(*name, "embedding"), name).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    met = store.keep(some.mapInArrow(meet, "id long, links long, root long"), "itq-met")
    parts = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        classes.select(*same, "rep", "m")
        .join(links, F.col("rep") == links.id, "left")
        .drop("id")
        .join(parts, F.col("rep") == parts.id, "left")
        .select(*same, "rep", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component")
    )
    # unusable vectors meet nothing, and no join key
    bad = v.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("rep"))
    out = good.select("vec_id", *same).join(named, same, "left").select("vec_id", "n", F.col("component").cast("long").alias("component"), F.col("rep").cast("long").alias("rep"))
    out = out.unionByName(bad)
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _models(classes: DataFrame, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A rotation per vector length, from at most ``sample`` vectors in all."""
    by: dict[int, list] = {}
    for r in classes.select("embedding", F.xxhash64("rep").alias("o")).orderBy("o").limit(sample).select("embedding").toLocalIterator():
        by.setdefault(len(r[0]), []).append(r[0])
    return {d: learn_rotation(unit(np.array(x, np.float64))) for d, x in by.items()}


def _verify(t: pa.Table, masks: list[int], threshold: float) -> pa.RecordBatch:
    x = unit(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64))
    code = buckets.column(t, "code").view(np.uint64)
    tab, label, m, rep = (buckets.column(t, c) for c in ("tab", "label", "m", "rep"))
    lo, hi = buckets.ranges(t)
    links = np.zeros(t.num_rows, np.int64)
    forest = buckets.Forest(t.num_rows)

    def count(a: np.ndarray, b: np.ndarray) -> None:
        apart = code[a] ^ code[b]
        earlier = np.zeros(len(a), bool)
        for k, mask in enumerate(masks[:-1]):
            earlier |= (tab[a] > k) & ((apart & np.uint64(mask)) == 0)
        ok = ~earlier & (label[a] == label[b]) & (np.bitwise_count(apart) <= FAR)
        a, b = a[ok], b[ok]
        np.add.at(links, a, m[b])
        np.add.at(links, b, m[a])
        forest.union(a, b)

    few = hi - lo <= 256
    for a, b in buckets.pairs(lo, np.where(few, hi, lo), 1 << 16):
        near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        count(a[near], b[near])
    many = np.flatnonzero(~few)
    for at in range(0, len(many), 256):
        r = many[at : at + 256]
        for s in range(int(lo[r].min()), int(hi[r].max()), 8192):
            c = np.arange(s, min(s + 8192, int(hi[r].max())))
            near = (x[r] @ x[c].T >= threshold) & (c[None] >= lo[r][:, None]) & (c[None] < hi[r][:, None])
            i, j = np.nonzero(near)
            count(r[i], c[j])
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[forest.root[hit]])], ["id", "links", "root"])
