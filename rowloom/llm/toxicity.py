"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds calibrated by language.

Words (lower-cased runs of letters, digits and non-ASCII bytes) get an embedding from two hashed tables side by side: one
of the whole word, one of its stem, the first ``STEM`` bytes, all begun at small random values. Filters of widths 1, 2 and
3 slide over the whole text; each filter's maximum, rectified, feeds a logistic output. Training walks whole texts of a bounded sample with Adam; buckets
that the sample never touches are zero afterwards, so an unknown word changes nothing.

On another part of the labelled rows a threshold is chosen for each language, told by the text's own function words,
and the score is the logistic output moved so that this threshold is 0.7.

Defined cases: null and empty texts are scored as one empty window; without labels of both kinds every score is 0.5;
repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import labelled, store, words
from rowloom.llm.quality import finish

BUCKETS, HALF, FILTERS, STEM = 1 << 16, 8, 8, 4
DIM, WIDTHS = 2 * HALF, (1, 2, 3)
COLUMNS = sum(WIDTHS) * FILTERS
EPOCHS, BATCH, RATE = 12, 64, 0.01
FOLDS, HELD_OUT, CALIBRATE = 3, 1, 2
CUT = 0.7
#: Words that go through the filters together.
PIECE = 1 << 16

#: Frequent function words that tell a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as by on are this be".split(),
    "fr": "le la les de des et un une que qui dans pour par du en est sur".split(),
    "de": "der die das und zu den von ist mit nicht ein eine im auf sich des".split(),
    "es": "el la los las de que y en un una por con para es del se no".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]


class Texts:
    """Word buckets of some texts, two zero words after each: ids a and b (bucket BUCKETS is the zero word), rows [first, last)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = words.Words(np.where(OTHER[data], np.uint8(32), data), offsets)
        n = len(offsets) - 1
        size = np.diff(w.first)
        self.first = w.first[:-1] + 2 * np.arange(n)
        self.size = size
        at = np.arange(len(w.hash)) + 2 * np.repeat(np.arange(n), size)
        total = len(w.hash) + 2 * n
        self.a, self.b = np.full(total, BUCKETS, np.int32), np.full(total, BUCKETS, np.int32)
        self.a[at] = (w.hash & np.uint64(BUCKETS - 1)).astype(np.int32)
        stem = w.cut(w.start, np.minimum(w.end, w.start + STEM))
        self.b[at] = (stem & np.uint64(BUCKETS - 1)).astype(np.int32)
        w.start = w.end = None
        text = np.repeat(np.arange(n, dtype=np.int32), size)
        votes = np.stack([np.bincount(text[np.isin(w.hash, h)], minlength=n) for h in _function_hashes()] + [np.full(n, 0.5)], axis=1)
        self.lang = votes.argmax(axis=1)


OTHER = np.ones(256, bool)
for _lo, _hi in ((48, 57), (97, 122), (128, 255)):
    OTHER[_lo : _hi + 1] = False
_FUNCTION: list[np.ndarray] = []


def _function_hashes() -> list[np.ndarray]:
    if not _FUNCTION:
        for lang in FUNCTION_WORDS.values():
            raw = " ".join(lang).encode()
            _FUNCTION.append(words.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash)
    return _FUNCTION


def texts_of(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    for i, data, off in words.chunks(column):
        yield i, Texts(data, off)


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.ea = (rng.standard_normal((BUCKETS + 1, HALF)) * 0.1).astype(np.float32)
        self.eb = (rng.standard_normal((BUCKETS + 1, HALF)) * 0.1).astype(np.float32)
        self.ea[-1] = self.eb[-1] = 0
        self.w = (rng.standard_normal((DIM, COLUMNS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.base = np.float32(-1.0)
        self.cuts = dict.fromkeys(LANGS, 0.0)
        self.trained = False

    def embed(self, t: Texts, rows: slice) -> np.ndarray:
        return np.hstack([self.ea[t.a[rows]], self.eb[t.b[rows]]])

    def slide(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs (words, filters); the last rows of a text, its zero words, complete its wider windows."""
        y = x @ self.w
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        c = 0
        for k, width in enumerate(WIDTHS):
            part = y[:, c : c + FILTERS].copy()
            for j in range(1, width):
                part[:-j] += y[j:, c + j * FILTERS : c + (j + 1) * FILTERS]
            out[:, k * FILTERS : (k + 1) * FILTERS] = part
            c += width * FILTERS
        return out

    def logits(self, t: Texts) -> np.ndarray:
        """Rows first + max(size, 1) of a text are its windows; zero words behind a text reach into no other. Words go through the
        filters in pieces of ``PIECE``, of which a text keeps the maxima."""
        if not len(t.first):
            return np.zeros(0)
        n = np.maximum(t.size, 1)
        top = np.full((len(n), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for lo in range(0, len(t.a), PIECE):
            hi = min(lo + PIECE, len(t.a))
            y = self.slide(self.embed(t, slice(lo, hi + max(WIDTHS) - 1)))
            own = np.arange(np.searchsorted(t.first, lo, "right") - 1, np.searchsorted(t.first, hi, "left"))
            start, end = np.maximum(t.first[own], lo) - lo, np.minimum(t.first[own] + n[own], hi) - lo
            own, start, end = own[end > start], start[end > start], end[end > start]
            if len(own):
                edge = np.stack([start, end], axis=1).ravel()
                part = np.maximum.reduceat(y, np.minimum(edge, len(y) - 1), axis=0)[::2]
                top[own] = np.maximum(top[own], part)
        return np.maximum(top + self.bias, 0) @ self.out + self.base

    def scores(self, t: Texts) -> np.ndarray:
        if not self.trained:
            return np.full(len(t.first), 0.5)
        cut = np.array([self.cuts[x] for x in LANGS])[t.lang]
        z = self.logits(t).astype(np.float64) - cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _join(texts: list[str]) -> Texts:
    raw = [x.encode() for x in texts]
    data = words.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    return Texts(data, np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))


def train(rows: list, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """rows: (text, label, fold, id, weight); folds other than CALIBRATE train, CALIBRATE sets the thresholds."""
    m = Model(seed)
    part = [r for r in rows if r[2] != CALIBRATE]
    y = np.array([r[1] for r in part], np.float32)
    if not 0 < y.sum() < len(y):
        return m
    t = _join([r[0] for r in part])
    rng = np.random.default_rng(seed)
    dense = [m.w, m.bias, m.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    grown = [np.full(len(m.ea), 1e-6, np.float32), np.full(len(m.eb), 1e-6, np.float32)]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            step += 1
            _step(m, t, docs, y[docs], weight[docs], dense, moments, grown, step)
    for e, ids in ((m.ea, t.a), (m.eb, t.b)):
        seen = np.zeros(len(e), bool)
        seen[ids] = True
        seen[-1] = False
        e[~seen] = 0
    m.trained = True
    held = [r for r in rows if r[2] == CALIBRATE]
    _calibrate(m, held or part)
    return m


def _step(m: Model, t: Texts, docs, y, weight, dense, moments, grown, step) -> None:
    f = len(WIDTHS) * FILTERS
    size = np.maximum(t.size[docs], 1)
    rows = np.concatenate([np.arange(t.first[d], t.first[d] + t.size[d] + 2) for d in docs])
    first = np.r_[0, np.cumsum(t.size[docs] + 2)[:-1]]
    a, b = t.a[rows], t.b[rows]
    x = np.hstack([m.ea[a], m.eb[b]])
    s = m.slide(x)
    where = np.stack([s[i : i + n].argmax(axis=0) + i for i, n in zip(first, size, strict=True)])
    top = np.take_along_axis(s, where, axis=0) + m.bias
    act = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.base, -30, 30)))
    dz = ((p - y) * weight / len(docs)).astype(np.float32)
    m.base -= np.float32(RATE * 5) * dz.sum()
    d_top = dz[:, None] * m.out[None] * (top > 0)
    d_w, d_x = np.zeros_like(m.w), np.zeros_like(x)
    c = 0
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        pos, g = where[:, own], d_top[:, own]
        for j in range(width):
            cols = slice(c + j * FILTERS, c + (j + 1) * FILTERS)
            at = np.minimum(pos + j, len(x) - 1)
            d_w[:, cols] = np.einsum("dfe,df->ef", x[at], g)
            np.add.at(d_x, at.ravel(), (g[:, :, None] * m.w[:, cols].T[None]).reshape(-1, DIM))
        c += width * FILTERS
    for param, grad, (m1, m2) in zip(dense, (d_w + 1e-4 * m.w, d_top.sum(axis=0), dz @ act + 1e-4 * m.out), moments, strict=True):
        m1 *= 0.9
        m1 += 0.1 * grad
        m2 *= 0.999
        m2 += 0.001 * grad * grad
        param -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    hit = np.flatnonzero(np.abs(d_x).sum(axis=1))
    for e, ids, half, acc in ((m.ea, a, d_x[:, :HALF], grown[0]), (m.eb, b, d_x[:, HALF:], grown[1])):
        u, inv = np.unique(ids[hit], return_inverse=True)
        g = np.zeros((len(u), HALF), np.float32)
        np.add.at(g, inv, half[hit])
        acc[u] += (g * g).mean(axis=1)
        e[u] -= 0.1 * g / np.sqrt(acc[u])[:, None]
        e[-1] = 0


def _best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which F1 of the weighted rows is largest."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    tp, n = np.cumsum(y * weight), np.cumsum(weight)
    last = np.r_[z[1:] != z[:-1], True]
    f1 = np.where(last, 2 * tp / (n + tp[-1]), -1)
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def _calibrate(m: Model, rows: list, least: int = 10) -> None:
    t = _join([r[0] for r in rows])
    y, z = np.array([r[1] for r in rows], float), m.logits(t).astype(np.float64)
    weight = np.array([r[4] for r in rows])
    whole = _best_cut(z, y, weight) if 0 < y.sum() < len(y) else 0.0
    for k, lang in enumerate(LANGS):
        own = t.lang == k
        enough = min(y[own].sum(), own.sum() - y[own].sum()) >= least
        m.cuts[lang] = _best_cut(z[own], y[own], weight[own]) if enough else whole


def scores(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    store.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(labelled.sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, t in texts_of(b.column("text")):
                s[i : i + len(t.first)] = model.value.scores(t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    d = store.columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return finish(d.mapInArrow(run, "doc_id long, score double"), FOLDS, HELD_OUT)
