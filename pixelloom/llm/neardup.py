"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, connected components.

A fingerprint has 8 bytes. Two that differ in at most 3 bits agree in at least
5 of the 8 byte positions (the guaranteed minimum), and in one half of the
positions in at least 3 of 4: three flips can't spoil two bytes of both halves.
The inverted index therefore lists fingerprints under (half, three positional
bytes), 8 postings each; a pair's shared positional bytes are tallied, pairs
under 5 are let go, the rest verified bit by bit. A list longer than
`group_rows` is split by two more of the 5 other positions (10 postings; two of
them must agree as well) and, if still longer, by three of the 6 half-bytes that
remain (20 postings; three flips leave three of them alike): 52 bits are then the same, so
no list holds over 4096 fingerprints, and none is cut. Groups give only a
spanning forest of their links, so large groups of near copies never become all pairs.

Equal fingerprints are one node from the start. Components are found by
alternating large-star and small-star rounds over written tables.

Defined results: null, empty or wordless texts have fingerprint zero, linked
like any other; repeated rows each get their row; a null doc_id never becomes a
component_id unless the whole component has none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, short_batches, text_column, work_dir, write_table

SHINGLE_WORDS = 3
MAX_BITS = 3
MIN_SHARED_BYTES = 5
GROUP_ROWS = 1024
_SEED = 42
_LOW = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_STEP = 1 << 14


def simhash(text: str, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "replace").translate(_LOW).split()
    n = max(0, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if not n:
        return int.from_bytes(digest(joined, _SEED), "big")
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, end = (end - length)[:n].tolist(), end[words_in_shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        raw = b"".join([digest(joined[a:b], _SEED) for a, b in zip(start[i : i + _STEP], end[i : i + _STEP], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((simhash(t) for t in text_column(batch, "text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": pa.array(fp.view(np.int64))})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint's bits as a long."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_batches, f"id {kind}, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _packed(tag: int, parts: list[Column]) -> Column:
    key = F.lit(tag).cast("long")
    for p in parts:
        key = F.shiftleft(key, 8).bitwiseOR(p)
    return key


def _triples() -> list[tuple[int, ...]]:
    return [tuple(4 * half + i for i in range(4) if i != gone) for half in (0, 1) for gone in range(4)]


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, fp): 8 postings of each fingerprint."""
    fp = F.col("fp")
    return nodes.select("fp", F.explode(F.array(*[_packed(t, [_byte(fp, i) for i in which]) for t, which in enumerate(_triples())])).alias("key"))


def _finer(postings: DataFrame) -> DataFrame:
    """(key, sub, fp): a long list's postings by two more positions that agree."""
    fp, tag = F.col("fp"), F.shiftrightunsigned("key", 24)
    choices = []
    for t, which in enumerate(_triples()):
        rest = [i for i in range(8) if i not in which]
        choices.append((t, F.array(*[_packed(p, [_byte(fp, a), _byte(fp, b)]) for p, (a, b) in enumerate(combinations(rest, 2))])))
    subs = F.coalesce(*[F.when(tag == t, c) for t, c in choices])
    return postings.select("key", "fp", F.explode(subs).alias("sub"))


def _finest(finer: DataFrame) -> DataFrame:
    """(key, sub, nibs, fp): a list's postings by three half-bytes that agree, of those that key and sub leave open."""
    fp, tag, pair = F.col("fp"), F.shiftrightunsigned("key", 24), F.shiftrightunsigned("sub", 16)
    choices = []
    for t, which in enumerate(_triples()):
        rest = [i for i in range(8) if i not in which]
        for p, two in enumerate(combinations(rest, 2)):
            open_ = [F.shiftrightunsigned(fp, 8 * i + 4 * half).bitwiseAND(F.lit(15)) for i in rest if i not in two for half in (0, 1)]
            choices.append(F.when((tag == t) & (pair == p), F.array(*[_packed(n, [open_[a], open_[b], open_[c]]) for n, (a, b, c) in enumerate(combinations(range(6), 3))])))
    return finer.select("key", "sub", "fp", F.explode(F.coalesce(*choices)).alias("nibs"))


def _forest(fps: np.ndarray, max_bits: int, min_shared: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links in a group."""
    u = fps.view(np.uint64)
    n = len(u)
    parent = np.arange(n)
    out_a, out_b = [], []
    positions = np.ascontiguousarray(u).view(np.uint8).reshape(n, 8)
    for i in range(n - 1):
        to = np.arange(i + 1, n)
        to = to[parent[to] != parent[i]]
        if not len(to):
            continue
        shared = (positions[to] == positions[i]).sum(axis=1)
        to = to[shared >= min_shared]
        to = to[np.bitwise_count(u[to] ^ u[i]) <= max_bits]
        for j in to.tolist():
            a, b = parent[i], parent[j]
            if a != b:
                parent[parent == b] = a
                out_a.append(int(fps[i]))
                out_b.append(int(fps[j]))
    return out_a, out_b


def _verify(max_bits: int, min_shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column("fps"):
                x, y = _forest(np.array(fps.values, np.int64), max_bits, min_shared)
                a += x
                b += y
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(nodes: DataFrame, folder: str, max_bits: int = MAX_BITS, min_shared: int = MIN_SHARED_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within max_bits, by way of others or directly."""
    postings = _postings(nodes)
    sizes = write_table(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/sizes")
    check = "a long, b long"

    def verified(rows: DataFrame, key: list[str]) -> DataFrame:
        return rows.groupBy(*key).agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_verify(max_bits, min_shared), check)

    def short(rows: DataFrame, counted: DataFrame, key: list[str]) -> DataFrame:
        return verified(rows.join(counted.where(F.col("n") <= group_rows).select(*key), key), key)

    found = [short(postings, sizes, ["key"])]
    if sizes.where(F.col("n") > group_rows).limit(1).count():
        finer = write_table(_finer(postings.join(sizes.where(F.col("n") > group_rows).select("key"), "key")), f"{folder}/finer")
        counted = finer.groupBy("key", "sub").agg(F.count("*").alias("n")).where("n > 1")
        found.append(short(finer, counted, ["key", "sub"]))
        # What is longer still: lists of 4096 at most.
        found.append(verified(_finest(finer.join(counted.where(F.col("n") > group_rows).select("key", "sub"), ["key", "sub"])), ["key", "sub", "nibs"]))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def connected_components(edges: DataFrame, folder: str, most_rounds: int = 40) -> DataFrame:
    """(node, root) of every node with an edge; root: the least node reachable. Alternating large-star and small-star rounds; each is written to the shared folder, so a lost executor costs a round at most."""
    spark = edges.sparkSession
    now = write_table(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v != u").distinct(), f"{folder}/cc/0")
    mark = None
    for k in range(1, most_rounds + 1):
        both = now.select("v", "u").unionAll(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(least.select("v", F.col("m").alias("u"))).where("v != u").distinct()
        now = write_table(small, f"{folder}/cc/{k}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        remove(spark, f"{folder}/cc/{k - 1}")
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each document: its id, fingerprint (16 hex digits) and component_id, the least id reachable over links."""
    folder = work_dir(docs.sparkSession, "neardup")
    fps = write_table(fingerprints(docs, id_col, text_col), f"{folder}/fps")
    nodes = write_table(fps.groupBy("fp").agg(F.min("id").alias("rep")), f"{folder}/nodes")
    roots = connected_components(links(nodes, folder, max_bits, group_rows=group_rows), folder)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = write_table(rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id"), f"{folder}/named")
    remove(docs.sparkSession, *(f"{folder}/{x}" for x in ("nodes", "sizes", "finer", "cc")))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the least id of each component, once, with all its columns; documents without an id stay. A document is an id with a text: an id that several texts share names them all."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    keyed = docs.withColumn("__key", F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), digest.alias("digest"))))
    found = near_duplicates(keyed, "__key", text_col, **options)
    kept = found.where(F.col("__key") == F.col("component_id")).select(F.col("__key").alias("__kept")).distinct()
    joined = keyed.join(kept, F.col("__key") == F.col("__kept")).groupBy("__key").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return joined.select("__row.*").unionByName(docs.where(F.col(id_col).isNull()))
