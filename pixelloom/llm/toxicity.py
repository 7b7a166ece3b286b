"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of a document's words, pairs of neighbours and pairs
with one word between (A-Z lower-cased), hashed to 2**22 coordinates. Training
has a learning rate of its own for each coordinate; L1 leaves few weights, so
what is broadcast is small: 2**22 pairs of coordinate and weight bound it.

Training reads a sample that two parameters bound: `sample` labelled documents
and `sample_bytes` bytes of text of each class, the first by a hash of the id (a text that
goes over the bytes is left out). It runs in one task, so a lost executor means
that the task is run again. Scoring reads every whole text, without a shuffle.

Defined results: null and wordless texts score by the intercept; with a class
missing among the labels every score is 0.5;
labels without a value are not read; repeated documents each get their row; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, short_batches, text_column, utf8, word_hashes, word_spans
from .quality import labelled_sample

BITS = 22
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
#: What a positive document weighs.
POSITIVE = 2.0


def grams(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, document) of each word, pair of neighbours and pair with one word between."""
    top = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        parts = [(mix(hashes), doc)]
        for gap, seed in ((1, 3), (2, 5)):
            if len(hashes) > gap:
                same = doc[gap:] == doc[:-gap]
                h = mix(hashes[:-gap] * np.uint64(2 * seed + 1) + mix(hashes[gap:] + np.uint64(seed)))
                parts.append((h[same], doc[gap:][same]))
    return np.concatenate([p[0] for p in parts]) >> top, np.concatenate([p[1] for p in parts])


class Ftrl:
    """FTRL-proximal with per-coordinate rates (McMahan et al., 2013), over presence features; the last coordinate is the intercept, without L1."""

    def __init__(self, l1: float = L1, size: int = (1 << BITS) + 1):
        self.l1, self.z, self.n = l1, np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates in order, their weights, and the intercept."""
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    found = []
    for first in range(0, len(texts), 256):
        data, offsets = utf8(pa.array(texts[first : first + 256], pa.string()))
        s, e, doc = word_spans(data, offsets)
        at, of = grams(word_hashes(data, s, e), doc)
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(len(offsets)))
        found += [np.append(np.unique(at[order[a:b]]).astype(np.int64), 1 << BITS) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    model, rng = Ftrl(), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(found)):
            model.learn(found[i], y[i], POSITIVE if y[i] else 1.0)
    at = np.flatnonzero(np.abs(model.z) > model.l1)
    at = at[at < 1 << BITS]
    w = model.weights(at)
    return at, w, float(model.weights(np.array([1 << BITS]))[0])


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(b.column("rank").to_pylist(), b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[0], str(r[1]), r[3]))
    at, w, bias = train([r[3] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1), pa.int64()), "w": pa.array(np.append(w, bias), pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    short_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label_col, F.lit(True) if use is None else use, sample, sample_bytes, id_col, text_col)
    got = rows.select("rank", "id", F.col("label").cast("int").alias("label"), "text").repartition(1).mapInArrow(_trainer, "at long, w double").toPandas().sort_values("at")
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return got["at"].to_numpy()[1:], got["w"].to_numpy()[1:], float(got["w"].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each document."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS pairs at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, weights, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[where] = weights
        for batch in batches:
            text = text_column(batch, "text")
            z = np.full(batch.num_rows, bias)
            for first, last, data, offsets in chunks(text):
                s, e, doc = word_spans(data, offsets)
                at, of = grams(word_hashes(data, s, e), doc)
                live = table[at] != 0
                once = np.unique(of[live].astype(np.int64) << BITS | at[live].astype(np.int64))
                z[first:last] += np.bincount(once >> BITS, table[once & ((1 << BITS) - 1)], minlength=last - first)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
