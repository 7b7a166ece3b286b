"""Compression classifier for quality.

Two zstandard dictionaries are built from labelled text, one from good and one
from bad documents. A text is cut into blocks of 2 KiB, each compressed with
either dictionary; the normalised difference of the two sizes, with their
share of the text and the products of both, goes through a logistic calibration fitted on
labelled documents that took no part in the dictionaries.

The sample of labelled documents is bounded by two parameters: `sample`
documents and `sample_bytes` bytes of text of each class (the first by a hash of
the id; a text that goes over the bytes is left out). Half of them are for the
dictionaries, which take `spread` blocks of a text at most, half for the
calibration. Everything else reads every whole text.

Defined results: null and empty texts get the score of a text without evidence
(the calibration's intercept); with fewer than LEAST sampled documents of a class
every score is 0.5; labels without a value are not read; a document labelled twice
counts with its larger label; of rows that share a labelled id the one with the
last text is learnt from; repeated documents each get their row; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_column, work_dir, write_table

BLOCK = 2048
SAMPLE = 1500
DICT_BYTES = 64 << 10
LEVEL = 3
#: Bytes of all sampled texts of a class, blocks of one text that a dictionary is made of, sampled documents of a class that learning needs.
SAMPLE_BYTES, SPREAD, LEAST = 24 << 20, 3, 4


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, use: Column, sample: int, sample_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text, rank): at most `sample` documents and `sample_bytes` bytes of either class, the first by a hash of the id, of the rows that `use` admits (over the labels). Written, so that a later stage reads the sample alone."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & use).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    picked = None
    for value in (0, 1):
        one = chosen.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = one if picked is None else picked.unionAll(one)
    # At most 2 * sample ids: bounded, so broadcast.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.max("text").alias("text")).withColumn("rank", F.xxhash64("id", F.lit(7)))
    got = write_table(got, work_dir(spark, "sample"))
    used, kept = {0: 0, 1: 0}, []
    for r in got.select("id", "label", F.octet_length("text").alias("n")).orderBy("rank", "id").collect():  # 2 * sample rows
        if used[r.label] + r.n <= sample_bytes:
            used[r.label] += r.n
            kept.append((r.id,))
    kind = docs.schema[id_col].dataType.simpleString()
    return got.join(F.broadcast(spark.createDataFrame(kept, f"id {kind}")), "id")


class Compressor:
    """Sizes of a text's blocks under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=DICT_BYTES, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.pair = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=options) for d in (good, bad)]

    def sizes(self, text: str) -> tuple[int, int, int]:
        raw = text.encode("utf-8", "replace")
        g, b = self.pair
        good = bad = 0
        for i in range(0, len(raw), BLOCK):
            block = raw[i : i + BLOCK]
            good += len(g.compress(block))
            bad += len(b.compress(block))
        return len(raw), good, bad

    def features(self, texts: list[str]) -> np.ndarray:
        n, good, bad = np.array([self.sizes(t) for t in texts], np.float64).reshape(-1, 3).T
        some = n > 0
        n, both = np.where(some, n, 1), np.where(some, good + bad, 1)
        diff = np.where(some, 10 * (bad - good) / both, 0)
        ratio = np.where(some, 5 * np.clip(both / (2 * n) - 0.3, -1, 1), 0)
        return np.stack([diff, ratio, diff * diff, ratio * ratio, diff * ratio], axis=1)


def build_dictionary(texts: list[str], spread: int = SPREAD) -> bytes:
    """A zstandard dictionary of the texts.

    Each text gives at most `spread` blocks from all over it, and equal blocks count
    once, so that a long text of one repeated word doesn't fill the dictionary.
    Where training still ends far below the size wanted, the dictionary's content is
    slices of all blocks alike.
    """
    blocks: dict[bytes, None] = {}
    for t in texts:
        raw = t.encode("utf-8", "replace")
        starts = range(0, len(raw), BLOCK)
        for k in sorted({j * (len(starts) - 1) // max(spread - 1, 1) for j in range(spread)}) if raw else ():
            blocks[raw[starts[k] : starts[k] + BLOCK]] = None
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, list(blocks)).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    if len(trained) >= DICT_BYTES // 2:
        return trained
    share = max(64, DICT_BYTES // max(len(blocks), 1))
    return b"".join(b[len(b) // 3 :][:share] for b in blocks)[-DICT_BYTES:]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with halved steps over standardised features; classes weigh alike."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, now):
            break
    w[:-1] /= spread
    w[-1] -= w[:-1] @ mean
    return w


class QualityModel:
    def __init__(self, good: bytes = b"", bad: bytes = b"", weights: np.ndarray | None = None):
        self.good, self.bad, self.weights = good, bad, weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, spread: int = SPREAD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
        """Trained on the driver, from the sample that `sample` and `sample_bytes` bound."""
        short_batches(docs.sparkSession)
        got = labelled_sample(docs, labels, label_col, F.lit(True) if use is None else use, sample, sample_bytes, id_col, text_col)
        rows = [(r.label, r.text) for r in got.orderBy("rank", "id").toLocalIterator()]
        part = {v: [t for label, t in rows if label == v] for v in (0, 1)}
        if min(map(len, part.values())) < LEAST:
            return cls()
        good, bad = (build_dictionary(part[v][::2], spread) for v in (1, 0))
        rest = [(v, t) for v in (0, 1) for t in part[v][1::2]]
        x = Compressor(good, bad).features([t for _, t in rest])
        return cls(good, bad, fit_logistic(x, np.array([v for v, _ in rest], np.float64)))

    def compressor(self) -> Compressor | None:
        return None if self.weights is None else Compressor(self.good, self.bad)

    def scores(self, texts: list[str], compressor: Compressor | None) -> np.ndarray:
        if compressor is None:
            return np.full(len(texts), 0.5)
        z = compressor.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each document."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = shared.value.compressor()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": shared.value.scores(text_column(batch, "text").to_pylist(), compressor)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score `threshold` or more, with all their columns, without a shuffle."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = shared.value.compressor()
        for batch in batches:
            s = shared.value.scores([t or "" for t in batch.column(at).to_pylist()], compressor)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
