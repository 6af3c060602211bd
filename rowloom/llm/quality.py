"""Quality by compression: zstandard dictionaries of good and of bad text, and which of the two shortens a text more.

Each dictionary is trained on pieces of labelled texts of its class. A text is cut into pieces of ``PIECE`` bytes, each
compressed with either dictionary; the difference of both totals over the text's length is turned into a probability by
a logistic fit on labelled texts that the dictionaries have not seen. A short text says little: its log odds are shrunk
towards those of the labels at large, half way at ``SHRINK`` bytes.

Defined cases: null and empty texts score as the labels at large; without labels of both kinds every score is 0.5; repeated
rows score alike; an empty table gives an empty result; extra columns are kept by ``keep_good``, ignored by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import labelled, store

PIECE = 512
DICT_BYTES = 1 << 15
SHRINK = 256.0
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3


class Model:
    """Two dictionaries and the logistic curve; travels to the tasks as plain bytes and numbers."""

    def __init__(self, bad: bytes, good: bytes, curve: tuple[float, float], prior: float = 0.0):
        self.dicts, self.curve, self.prior, self.ready = (bad, good), curve, prior, None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def sizes(self, text: bytes) -> tuple[int, int]:
        if self.ready is None:
            self.ready = [compressor(d) for d in self.dicts]
        pieces = [text[a : a + PIECE] for a in range(0, len(text), PIECE)]
        a, b = (sum(len(c.compress(p)) for p in pieces) for c in self.ready)
        return a, b

    def difference(self, text: str | None) -> float:
        raw = (text or "").encode()
        a, b = self.sizes(raw)
        return (a - b) / max(len(raw), 1)

    def scores(self, texts: list) -> np.ndarray:
        d = np.array([self.difference(t) for t in texts], float)
        n = np.array([len((t or "").encode()) for t in texts], float)
        z = (n * (self.curve[0] * d + self.curve[1]) + SHRINK * self.prior) / (n + SHRINK)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that take little memory as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    d.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def dictionary(texts: list[str], size: int = DICT_BYTES) -> bytes:
    pieces = [raw[a : a + PIECE] for t in texts for raw in (t.encode(),) for a in range(0, len(raw), PIECE)]
    whole = b"".join(pieces)
    if len(whole) >= 4 * size:
        try:
            return zstandard.train_dictionary(size, pieces, k=64, d=8).as_bytes()
        except zstandard.ZstdError:  # too little variety to train on: the text itself serves
            pass
    return whole[:size] or b"        "


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps with a small ridge, x scaled to unit spread."""
    s = max(float(np.std(x)), 1e-9)
    a = np.stack([x / s, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + np.array([1e-2, 0]) * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        d = np.linalg.solve(h, g)
        w = w - d * min(1.0, 4 / max(np.abs(d).max(), 1e-12))
        if np.abs(d).max() < 1e-8:
            break
    return float(w[0] / s), float(w[1])


def fit(rows: list, calibrate: int = CALIBRATE) -> Model:
    """rows: (text, label, fold, id, weight)."""
    by = {v: [r[0] for r in rows if r[1] == v and r[2] != calibrate] for v in (0, 1)}
    model = Model(dictionary(by[0]), dictionary(by[1]), (0.0, 0.0))
    held = [r for r in rows if r[2] == calibrate]
    y = np.array([r[1] for r in held], float)
    if by[0] and by[1] and 0 < y.sum() < len(y):
        weight = np.array([r[4] for r in held])
        model.curve = logistic(np.array([model.difference(r[0]) for r in held]), y, weight)
        model.prior = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS) -> Model:
    store.small_batches(docs.sparkSession)
    return fit(labelled.sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class))


def scores(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.scores(b.column("text").to_pylist()))], ["doc_id", "score"])

    d = store.columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return finish(d.mapInArrow(run, "doc_id long, score double"), FOLDS, HELD_OUT)


def finish(scored: DataFrame, folds: int, held_out: int, threshold: float = 0.7) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(labelled.fold(folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = labelled.PER_CLASS) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array(model.value.scores(b.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
