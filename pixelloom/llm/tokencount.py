"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content together with the
tokenizer's own digest. Counts that the cache holds are joined; of the others
each distinct content is encoded once and its count appended to the cache.

Normalisation changes no count: the tokenizer at hand lower-cases and folds
white space itself, so A-Z and runs of ASCII white space are folded before the
digest, unless the text holds "<|", as the tokenizer looks for special strings
in the raw text. For other tokenizers it must be switched off.

Copies are dropped twice, in the task that reads them and in the one that
encodes, so a text that a third of all rows repeat moves once per reading task. Back to
the rows, the counts of digests that over 1 / HOT_SHARE of all rows share are
broadcast (HOT_SHARE at most), so those rows don't meet in one task; all others are
joined. `fold` says that the tokenizer lower-cases and that white space only separates
its tokens.

Defined results: null texts count as empty ones, 0 bytes and 0 tokens; repeated
rows each get their row; an empty table gives an empty result and appends
nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, work_dir, write_table

OVER = 2048
#: Pieces between white space whose counts a worker remembers, and the longest that it remembers.
REMEMBERED, REMEMBERED_BYTES = 800_000, 64
#: Digests that a task remembers, so as not to pass a text on twice; forgetting one costs an encoding, no result.
SEEN = 1_000_000
HOT_SHARE = 1000
_TOKENIZERS: dict[tuple[str, bool], object] = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts of the library that the file belongs to, without begin, end or added special tokens.

    apart: no token of the tokenizer reaches over ASCII white space and none is
    made of it (so for word_bpe_49k.json). A text's count is then the sum over
    its pieces, and pieces seen before need no encoding.
    """

    def __init__(self, path: str, apart: bool):
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            of = Tokenizer.from_file(path)
            of.no_truncation()
            of.no_padding()
            self.encoded = lambda texts: [len(e) for e in of.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            of = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encoded = lambda texts: [len(e) for e in of.encode(texts, num_threads=1)]
        self.apart, self.known = apart, {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return self.encoded(texts)
        pieces = [t.encode("utf-8", "replace").split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*pieces).difference(self.known))
        found = dict(zip(new, self.encoded([p.decode() for p in new]), strict=True))
        self.known.update((p, n) for p, n in found.items() if len(p) <= REMEMBERED_BYTES)
        found.update((p, self.known[p]) for p in set().union(*pieces).difference(found))
        return [sum(map(found.__getitem__, p)) for p in pieces]


def counter(path: str, apart: bool = False) -> Counter:
    if (path, apart) not in _TOKENIZERS:
        _TOKENIZERS[path, apart] = Counter(path, apart)
    return _TOKENIZERS[path, apart]


def normalised(text: Column) -> Column:
    """The content that stands for all texts that differ in case or white space alone."""
    # Single spaces, the most of all, need no replacement.
    folded = F.translate(F.regexp_replace(text, "[\\x09-\\x0D\\x20]{2,}|[\\x09-\\x0D]", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(text, F.lit("<|")), text).otherwise(folded)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        if len(seen) > SEEN:
            seen = set()
        yield batch.filter(pa.array(keep, pa.bool_()))


def _encode(path: str, apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, apart).counts
        for batch in _once(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "n_tokens": pa.array(count(batch.column("content").to_pylist()), pa.int64())})

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", over: int = OVER, fold: bool = True) -> DataFrame:
    """A row for each document: its id, n_bytes, n_tokens, over_limit. cache: the cache's path (Parquet, appended to); a fresh one for this run where none is given."""
    spark = docs.sparkSession
    short_batches(spark)
    version = tokenizer_version(tokenizer)
    cache = cache or work_dir(spark, "token-counts")
    fields = "digest binary, tokenizer string, n_tokens long"
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = normalised(text) if fold else text
    digest = F.unhex(F.sha2(content, 256))
    keyed = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    keyed = write_table(keyed, work_dir(spark, "digests"))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        known = spark.read.schema(fields).parquet(cache).where(F.col("tokenizer") == version)
        todo = docs.select(digest.alias("digest"), content.alias("content")).join(known.select("digest").distinct(), "digest", "left_anti")
    else:
        todo = docs.select(digest.alias("digest"), content.alias("content"))
    misses = todo.mapInArrow(_once, "digest binary, content string")
    misses = misses.repartition(F.col("digest")).mapInArrow(_encode(tokenizer, fold), "digest binary, n_tokens long")
    misses.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # A cache that two runs appended to at once may hold a digest twice, with the same count.
    known = spark.read.schema(fields).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    often = keyed.groupBy("digest").agg(F.count("*").alias("rows")).where(F.col("rows") * HOT_SHARE > keyed.count())
    hot = write_table(often.join(known, "digest").select("digest", F.col("n_tokens").alias("n_hot")), work_dir(spark, "hot-counts"))
    marked = keyed.join(F.broadcast(hot), "digest", "left")  # HOT_SHARE rows at most
    out = marked.where("n_hot IS NOT NULL").withColumnRenamed("n_hot", "n_tokens").unionByName(marked.where("n_hot IS NULL").drop("n_hot").join(known, "digest"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
