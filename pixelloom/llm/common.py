"""Helpers that the operators of this subpackage share: the shared work folder, bounded Arrow batches, fast word hashing over Arrow buffers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_dir, ship

#: Rows and bytes of one Arrow batch: whole texts may be long, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for the written tables of one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes and rereads a table: lineage ends here, and any executor can read it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Before any Python stage: bounds the rows and bytes of an Arrow batch, so that long texts don't fill a worker's memory (one text over the bytes is a batch of its own), and ships the package. Spark reads both settings when a result is used, so they stay set; smaller ones are left as they are."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        now = int(now) if now.lstrip("-").isdigit() else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def bucket_of(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(k))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "") if col.null_count else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more than there are texts)."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of `most` bytes together, or of one longer text."""
    data, offsets = utf8(col)
    first, n = 0, len(col)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_B = np.arange(256)
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F], A-Z lower-cased first.
WORD_BYTES = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def hash_one(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and text number of each word; no word spans two texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[data]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[begins] = False
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[begins[begins > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    return starts, np.flatnonzero(m & ~after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each word with A-Z in lower case; alike on every machine."""
    h = np.zeros(len(starts), np.uint64)
    length = ends - starts
    short = length <= _LONG
    live = np.flatnonzero(short)
    j = 0
    with np.errstate(over="ignore"):
        while len(live):
            h[live] = (h[live] + _LOWER[data[starts[live] + j]] + np.uint64(1)) * _M1
            h[live] ^= h[live] >> np.uint64(31)
            j += 1
            live = live[length[live] > j]
        h = mix(h) | np.uint64(1)
    for i in np.flatnonzero(~short):
        h[i] = hash_one(_LOWER[data[starts[i] : ends[i]]].tobytes())
    return h


def hashed_words(text: str) -> tuple[np.ndarray, list[bytes]]:
    """The hashes and the lower-cased bytes of one text's words."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)], np.int64))
    low = _LOWER[raw]
    return word_hashes(raw, s, e), [low[a:b].tobytes() for a, b in zip(s, e, strict=True)]
