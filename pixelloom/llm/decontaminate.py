"""Benchmark decontamination with training suffix arrays.

A task turns its documents, some megabytes at a time, into a shard: the word
positions where any test suffix could begin, sorted by the words that follow
(a sparse suffix array: positions whose first words begin no test window can't
match one and are left out, without loss). Every test suffix is then
binary-searched in every shard. An interval of the array is the set of all
places where the window occurs; windows that continue each other are joined
to the longest verbatim match. No shuffle, no key, so neither copies nor hot
sources matter. The benchmark is searched in blocks of bounded bytes, of which a task
holds one at a time.

Defined results: null or wordless texts have 0 words and no match; items without a
text and wordless items match nothing; items without an id match, without a name; equal items each count; repeated documents
each get their row; an empty benchmark leaves all documents clean; other
columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hashed_words, mix, short_batches, text_column, word_hashes, word_spans

WINDOW = 10
#: Bytes of benchmark text that a block, which is broadcast, may hold; of texts that several blocks are searched in together.
BLOCK_BYTES, HELD_BYTES = 8 << 20, 64 << 20
_MATCHES = "array<struct<item:string,doc_start:long,item_start:long,n_words:long>>"
_MATCH_TYPE = pa.list_(pa.struct([("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())]))


class TestSuffixes:
    """The windows of a block of items, as search keys."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window, self.names, self.words = window, [], []
        owner, begin, length, keys = [], [], [], []
        for name, text in items:
            h, words = hashed_words(text)
            if not len(h):
                continue
            k = len(self.names)
            self.names.append(name)
            self.words.append(words)
            n = min(window, len(h))
            for i in range(len(h) - n + 1):
                row = np.zeros(window, np.uint64)
                row[:n] = h[i : i + n]
                owner.append(k)
                begin.append(i)
                length.append(n)
                keys.append(row)
        self.owner, self.begin, self.length = (np.array(x, np.int64) for x in (owner, begin, length))
        self.keys = np.array(keys, np.uint64).reshape(-1, window)
        #: What a match must begin with, by number of words; positions that begin otherwise are no candidates.
        head = np.minimum(self.length, 3)
        self.heads = {int(p): np.unique(self.head(self.keys[head == p].T[:p])) for p in np.unique(head)}

    @staticmethod
    def head(columns: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.zeros(columns.shape[1], np.uint64)
            for c in columns:
                h = mix(h * np.uint64(31) + c)
        return h


def _rows(keys: np.ndarray) -> np.ndarray:
    """Keys whose order as bytes is the order of their words' hashes."""
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{8 * keys.shape[1]}").ravel()


class Shard:
    """The sparse suffix array of some documents' words."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, tests: TestSuffixes):
        n, w = len(hashes), tests.window
        keep = np.zeros(n, bool)
        for p, heads in tests.heads.items():
            if n < p:
                continue
            first = np.flatnonzero(np.isin(hashes[: n - p + 1], np.unique(tests.keys[np.minimum(tests.length, 3) == p, 0])))
            first = first[doc[first] == doc[first + p - 1]]
            h = tests.head(np.stack([hashes[first + j] for j in range(p)])) if len(first) else np.zeros(0, np.uint64)
            keep[first[np.isin(h, heads)]] = True
        at = np.flatnonzero(keep)
        keys = np.zeros((len(at), w), np.uint64)
        for j in range(w):
            to = np.minimum(at + j, n - 1)
            keys[:, j] = np.where((at + j < n) & (doc[to] == doc[at]), hashes[to], np.uint64(0))
        order = np.lexsort(keys.T[::-1])
        self.at, self.rows = at[order], _rows(keys[order])

    def search(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of each occurrence of each window."""
        if not len(self.at) or not len(tests.keys):
            z = np.zeros(0, np.int64)
            return z, z
        upper = tests.keys.copy()
        upper[np.arange(tests.window)[None, :] >= tests.length[:, None]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        lo, hi = np.searchsorted(self.rows, _rows(tests.keys), "left"), np.searchsorted(self.rows, _rows(upper), "right")
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return self.at[lo[which] + inside], which


def _longest(at: np.ndarray, which: np.ndarray, doc: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """Joins windows that continue each other: (document, item, word position, item position, words)."""
    item, begin, size = tests.owner[which], tests.begin[which], tests.length[which]
    line = at - begin
    order = np.lexsort((at, line, item, doc[at]))
    at, item, begin, size, line, d = at[order], item[order], begin[order], size[order], line[order], doc[at[order]]
    new = np.ones(len(at), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return d[first], item[first], at[first], begin[first], at[last] + size[last] - at[first]


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _search_batch(batch: pa.RecordBatch, tests: TestSuffixes, found: list[list[dict]]) -> np.ndarray:
    """Adds the matches of a block's items in each text of the batch; the texts' numbers of words."""
    text = text_column(batch, "text")
    n_words = np.zeros(batch.num_rows, np.int64)
    for first, last, data, offsets in chunks(text):
        s, e, doc = word_spans(data, offsets)
        n_words[first:last] += np.bincount(doc, minlength=last - first)
        if not len(s):
            continue
        h = word_hashes(data, s, e)
        at, which = Shard(h, doc, tests).search(tests)
        if not len(at):
            continue
        begin = np.searchsorted(doc, np.arange(last - first))
        words: dict[int, list[bytes]] = {}
        for d, item, where, start, size in zip(*(x.tolist() for x in _longest(at, which, doc, tests)), strict=True):
            where -= int(begin[d])
            if d not in words:
                words = {d: hashed_words(text[first + d].as_py())[1]}
            if words[d][where : where + size] == tests.words[item][start : start + size]:  # equal hashes are not proof
                found[first + d].append({"item": tests.names[item], "doc_start": where, "item_start": start, "n_words": size})
    return n_words


def _search(blocks: list, held_bytes: int):
    """One stage over the texts for all blocks: a task holds one block at a time, and `held_bytes` of texts (or one batch) that each block is searched in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = TestSuffixes(*blocks[0].value) if len(blocks) == 1 else None

        def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[list[list[dict]]] = [[[] for _ in range(b.num_rows)] for b in held]
            n_words = [np.zeros(b.num_rows, np.int64) for b in held]
            for block in blocks:
                tests = only or TestSuffixes(*block.value)
                if only is None:
                    vars(block).pop("_value", None)  # the next use reads the file again
                n_words = [_search_batch(b, tests, f) for b, f in zip(held, found, strict=True)]
            for batch, n, f in zip(held, n_words, found, strict=True):
                hit = [_covered([(m["doc_start"], m["doc_start"] + m["n_words"]) for m in x]) for x in f]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "matches": pa.array(f, _MATCH_TYPE), "n_words": pa.array(n), "n_hit": pa.array(hit, pa.int64())})

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if only is not None or size > held_bytes:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each document: its id, n_words, n_hit (words in any occurring window) and matches, the longest verbatim matches with their places, in words."""
    spark = docs.sparkSession
    short_batches(spark)
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    blocks = []
    for b in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        blocks.append(spark.sparkContext.broadcast(([(r.i, r.t) for r in part.collect()], window)))  # about block_bytes
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_search(blocks, held_bytes), f"id {kind}, matches {_MATCHES}, n_words long, n_hit long")
    return out.withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns. Each row is judged by its own text, so ids may be null or repeated."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col))
    return find_matches(rows, benchmark, "__row", text_col, **options).where("n_hit = 0").select("__row.*")
