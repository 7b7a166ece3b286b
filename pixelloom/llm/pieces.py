"""SentencePiece encoding and decoding on a relational lattice.

A text is cut into words (leading white space, as the piece alphabet writes it,
and a run of characters that pieces join to letters, or of others), and words into
parts wherever no piece of the vocabulary holds the two characters on either side: no
merge reaches over such a place. Of each part all substrings of at most the longest piece's length are
exploded and equi-joined to the piece table, which the vocabulary file bounds.
The edges that join are grouped by part and folded with Spark's higher-order
`aggregate` into a bit mask of the boundaries that stand in the end.

The fold is not Viterbi's: the public model is a BPE model, whose encoding is
defined by merge priority and not by the best sum of scores, and a Viterbi
path over it gives other ids than the library. Edges are folded in order of
priority (then place, then length): an edge is taken if it starts and ends at
standing boundaries and exactly one stands between. Parts of a piece have a
higher priority than the piece, so one pass gives the library's ids; tests compare
them.

The lattice meets each frequent part once: those of `sample` documents, the
first by a hash of the text, fill a dictionary of `hot` parts, which is
broadcast. It saves work only; ids don't depend on what it holds. One pass over all
documents then writes known parts' ids and leaves holes for the others. These
travel once, to the task that their document goes to, are cut there by the lattice
and fill the holes. Rows have keys of their own (task and place in it), so neither copies
nor equal ids meet in one group.

The library itself encodes what the mask can't hold (parts of over MAX_PART code
points) and runs of white space, whose pieces break the rule that parts come first.
Characters without a piece are written as their UTF-8 bytes' pieces.

Decoding looks each id up in the table of the pieces' bytes and joins them.

Defined results: null and empty texts have no pieces; repeated rows each get their
row; a kept column named like a result gives way to it; other columns are not
read; an empty table gives an empty result. `docs` must give the same rows in the same
order when a task is run again, as files do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

SPACE = "▁"
MAX_PART = 60
#: Parts of the broadcast dictionary, and documents that it is made of.
HOT, SAMPLE = 500_000, 50_000
#: Distinct words that a counting task holds before it passes its counts on, and words that an encoding one remembers.
HELD, REMEMBERED = 200_000, 200_000
#: Words of a text that are handled at once.
RUN = 1 << 18
_MODELS: dict[str, object] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def library(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Vocabulary:
    """rows: (piece, rank) of normal pieces of two characters or more, by priority; ids of all normal pieces; pairs of characters that some piece holds."""

    def __init__(self, path: str):
        sp = self.model = library(path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranks = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in normal}))}
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.rows = [(p, ranks[-sp.get_score(i)]) for p, i in self.ids.items() if len(p) > 1]
        self.longest = max(len(p) for p in self.ids)
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.byte0, self.space = sp.piece_to_id("<0x00>"), sp.piece_to_id(SPACE)
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in self.ids) or self.longest > 31 or len(ranks) > 1 << 20:
            raise ValueError("a piece reaches over words, or the vocabulary is too large for packed edges")
        self._dummy = len(sp.encode("\n"))
        # The characters that pieces join to "e", in any number of steps: no piece holds one of them and one of the others, but for the space.
        letters, todo = {"e"}, ["e"]
        beside: dict[str, set[str]] = {}
        for a, b in self.pairs:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
        while todo:
            for c in beside.get(todo.pop(), set()) - letters - {SPACE, "\n"}:
                letters.add(c)
                todo.append(c)
        of_word = "".join(map(re.escape, sorted(letters)))
        self._split = re.compile(f"{SPACE}*[{of_word}]+|{SPACE}*[^{of_word}{SPACE}\n]+|{SPACE}+|\n")

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in order, RUN at a time: white space is written as pieces write it, a dummy space goes before the text."""
        if not text:
            return
        marked = SPACE + text.replace(" ", SPACE)
        if len(marked) <= RUN:
            yield self._split.findall(marked)
            return
        found = (m.group() for m in self._split.finditer(marked))
        while some := list(islice(found, RUN)):
            yield some

    def parts(self, word: str) -> list[str]:
        """The word, cut where no piece can reach over."""
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def by_library(self, word: str) -> bytes:
        # A word that begins with a space gets one less, which the dummy space makes up for; before others a line break keeps the dummy apart.
        if word[0] == SPACE and len(word) > 1:
            return _packed(self.model.encode(word[1:].replace(SPACE, " ")))
        return _packed(self.model.encode("\n" + word.replace(SPACE, " "))[self._dummy :])

    def cut(self, part: str, mask: int) -> list[int]:
        """The ids of a part, of which the mask tells the boundaries."""
        out, a = [], 0
        for b in range(1, len(part) + 1):
            if mask >> b & 1:
                found = self.ids.get(part[a:b])
                out += self.piece(part[a:b]) if found is None else (found,)
                a = b
        return out

    def piece(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte0 + b for b in piece.encode()]

    def surfaces(self) -> pa.Array:
        """What each id stands for, as bytes."""
        sp = self.model
        return pa.array([sp.id_to_piece(i).replace(SPACE, " ").encode() if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) else bytes([i - self.byte0]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else b"" for i in range(sp.get_piece_size())], pa.binary())


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def in_lattice(part: str) -> bool:
    return 1 < len(part) <= MAX_PART and part[:2] != SPACE * 2


class Words(dict):
    """Word → its ids as bytes, or, of one with parts that are not known, a list of bytes and those parts. Holds the known parts and, up to a number, words made of them."""

    def __init__(self, known: dict[str, bytes], path: str):
        super().__init__(known)
        self.known, self.of = known, vocabulary(path)
        self.single = {}

    def __missing__(self, word: str) -> bytes | list[bytes | str]:
        if len(self) > len(self.known) + REMEMBERED:
            self.clear()
            self.update(self.known)
        found = self.behind(word) if word[:2] == SPACE * 2 else self.joined(word)
        if type(found) is bytes:
            self[word] = found
        return found

    def joined(self, word: str) -> bytes | list[bytes | str]:
        out = [self.part(p) for p in self.of.parts(word)]
        return out if any(type(x) is str for x in out) else b"".join(out)

    def part(self, part: str) -> bytes | str:
        if len(part) == 1:
            return self.single.get(part) or self.single.setdefault(part, _packed(self.of.piece(part)))
        return self.known.get(part) or (part if in_lattice(part) else self.of.by_library(part))

    def behind(self, word: str) -> bytes | list[bytes | str]:
        """A word behind more than one space: behind one, and the rest of the run by itself."""
        rest = word.lstrip(SPACE)
        more = len(word) - len(rest)
        found = self[SPACE + rest] if rest else None
        first = found[0] if type(found) is list else found
        if type(first) is not bytes:
            return self.of.by_library(word)
        alone = first[:4] == _packed([self.of.space])
        run, first = (self[SPACE * more], first[4:]) if alone else (self[SPACE * (more - 1)], first)
        return run + first if type(found) is bytes else [run + first, *found[1:]]


def _counts(path: str):
    """Texts → (word, n): the parts that the lattice can cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            parts: Counter[str] = Counter()
            for w, n in held.items():
                for p in of.parts(w if w[:2] != SPACE * 2 else SPACE + w.lstrip(SPACE)):
                    if in_lattice(p):
                        parts[p] += n
            held.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(parts), pa.string()), "n": pa.array(list(parts.values()), pa.int64())})

        for batch in batches:
            for t in batch.column("text").to_pylist():
                for words in of.words(t or ""):
                    held.update(words)
                    if len(held) > HELD:
                        yield out()
        yield out()

    return run


def boundaries(rows: DataFrame, by: tuple[str, ...], path: str, *carried: str) -> DataFrame:
    """(by, word, carried, mask): the boundaries that stand in each word in the end, as bits; null where word is null. One row a group of `by`, in which rows are already dealt."""
    of = vocabulary(path)
    pieces = rows.sparkSession.createDataFrame(pa.table({"piece": [p for p, _ in of.rows], "rank": pa.array([r for _, r in of.rows], pa.int32())}))
    rows = rows.select(*by, "word", *carried)
    starts = rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.char_length("word") - 2)).alias("s"))
    parts = starts.select("*", F.explode_outer(F.sequence(F.lit(2), F.least(F.lit(of.longest), F.char_length("word") - F.col("s")))).alias("len"))
    parts = parts.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("len")))
    # The first row stays, so that a word without an edge does.
    met = parts.join(F.broadcast(pieces), "piece", "left").where(F.col("rank").isNotNull() | (F.coalesce("s", F.lit(0)) + F.coalesce("len", F.lit(2)) == 2))
    # An edge in one int, in order of priority, place, length.
    edge = F.shiftleft("rank", 11).bitwiseOR(F.shiftleft("s", 5)).bitwiseOR(F.col("len"))
    kept = [F.first(c, ignorenulls=True).alias(c) for c in ("word", *carried)]
    grouped = met.select(*by, "word", *carried, edge.alias("e")).groupBy(*by).agg(*kept, F.sort_array(F.collect_list("e")).alias("edges"))
    start, size = "shiftright(e, 5) & 63", "(e & 31)"
    ends, inner = f"shiftleft(shiftleft(1L, {size}) + 1L, {start})", f"shiftleft(shiftleft(1L, {size}) - 2L, {start})"
    fold = f"aggregate(edges, shiftleft(1L, char_length(word) + 1) - 1L, (m, e) -> CASE WHEN (m & {ends}) = {ends} AND bit_count(m & {inner}) = 1 THEN m & ~{inner} ELSE m END)"
    return grouped.select(*by, "word", *carried, F.expr(fold).alias("mask"))


def dictionary(docs: DataFrame, path: str, hot: int, sample: int) -> dict[str, bytes]:
    """The ids of at most `hot` parts, the most frequent of `sample` documents (in the mean). docs: (text)."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(max(1, -(-n // sample)))) == 0)
    words = some.mapInArrow(_counts(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = words.where("n > 1").orderBy(F.desc("n"), "word").limit(hot)
    dealt = frequent.select("word").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("word"))
    of = vocabulary(path)
    cut = boundaries(dealt.withColumn("key", F.col("word")), ("key",), path).select("word", "mask")
    return {r["word"]: _packed(of.cut(r["word"], r["mask"])) for r in cut.toLocalIterator()}  # `hot` rows


_WORKERS: dict[object, Words] = {}


def _with_holes(known, path: str, kind: str):
    """(row, text) → a row for each document: key, row and the ids, packed, where -1 - place stands for an unknown part; and one for each such part: key, place, word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[path] = Words(known.value, path)
        words, press = _WORKERS[path], zstandard.ZstdCompressor(level=1)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            packed, keys, places, rare = [], [], [], []
            first = key
            for t in batch.column("text").to_pylist():
                own: dict[str, int] = {}

                def holes(x: list[bytes | str], own: dict[str, int] = own) -> bytes:
                    return b"".join([p if type(p) is bytes else (~own.setdefault(p, len(own))).to_bytes(4, "little", signed=True) for p in x])

                out = []
                for some in words.of.words(t or ""):
                    found = list(map(words.__getitem__, some))
                    try:
                        out.append(b"".join(found))
                    except TypeError:
                        out.append(b"".join([x if type(x) is bytes else holes(x) for x in found]))
                packed.append(press.compress(b"".join(out)))
                keys += [key] * len(own)
                places += range(len(own))
                rare += own
                key += 1
            n, m = batch.num_rows, len(rare)
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays(
                [pa.array([*range(first, key), *keys], pa.int64()), pa.array([-1] * n + places, pa.int32()), pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(rare, pa.string())]), pa.concat_arrays([row, pa.nulls(m, row.type)]), pa.concat_arrays([pa.array(packed, pa.binary()), pa.nulls(m, pa.binary())])],
                names=["key", "place", "word", "row", "packed"],
            )

    return run


def _filled(path: str):
    """Rows with their packed ids and their unknown parts → row, ids: all holes of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, press = vocabulary(path), zstandard.ZstdDecompressor()
        for batch in batches:
            docs = [np.frombuffer(press.decompress(p), np.int32) for p in batch.column("packed").to_pylist()]
            ids = np.concatenate(docs) if docs else np.zeros(0, np.int32)
            doc = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
            lists = batch.column("own")
            place, word, mask = lists.flatten().flatten()
            sizes = pc.list_value_length(lists).to_numpy()
            first = np.cumsum(sizes) - sizes  # of each document's parts
            slot = np.repeat(first, sizes) + place.to_numpy()
            cuts: list[list[int]] = [[]] * len(slot)
            for k, w, m in zip(slot.tolist(), word.to_pylist(), mask.to_pylist(), strict=True):
                cuts[k] = of.cut(w, m)
            long = np.array([*map(len, cuts), 1])  # last: what is no hole
            flat = np.array([i for c in cuts for i in c], np.int32)
            begin = np.cumsum(long) - long
            hole = np.where(ids < 0, first[doc] + ~ids if len(doc) else 0, len(cuts))
            at = np.repeat(np.arange(len(ids)), long[hole])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(long[hole]) - long[hole], long[hole])
            out = ids[at]
            filled = hole[at] < len(cuts)
            out[filled] = flat[(begin[hole[at]] + inside)[filled]]
            ends = np.searchsorted(doc[at], np.arange(len(docs) + 1)) if len(docs) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))], names=["row", "ids"])

    return run


def _kept(docs: DataFrame, keep: tuple[str, ...], result: str) -> tuple[list[str], F.Column]:
    """The columns to keep, and a struct of them under names of its own."""
    names = [c for c in keep if c != result]
    return names, F.struct(F.lit(0).cast("byte").alias("one"), *[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(names)]).alias("row")


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """A row for each document: the columns of `keep`, and ids (array<int>), the library's ids of the whole text."""
    spark = docs.sparkSession
    short_batches(spark)
    path = path or default_model()
    known = spark.sparkContext.broadcast(dictionary(docs.select(F.col(text_col).alias("text")), path, hot, sample))
    names, row = _kept(docs, keep, "ids")
    rows = docs.select(row, F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    parts = rows.mapInArrow(_with_holes(known, path, kind), f"key long, place int, word string, row {kind}, packed binary")
    # Documents and their unknown parts are dealt once; no grouping below needs another exchange.
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("key"))
    cut = boundaries(dealt, ("key", "place"), path, "row", "packed")
    own = F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "word", "mask"))).alias("own")
    whole = cut.groupBy("key").agg(F.first("row", ignorenulls=True).alias("row"), F.first("packed", ignorenulls=True).alias("packed"), own)
    out = whole.select("row", "packed", "own").mapInArrow(_filled(path), f"row {kind}, ids array<int>")
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)], "ids")


def decode(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and text, which the ids stand for: null ids and ids outside the vocabulary stand for nothing."""
    short_batches(encoded.sparkSession)
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = vocabulary(path).surfaces()
        n = len(surfaces)
        # A text's first piece without its space, the dummy, comes from the second half.
        both = pa.concat_arrays([surfaces, pa.array([t[1:] if t[:1] == b" " else t for t in surfaces.to_pylist()], pa.binary())])
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ids = lists.flatten().cast(pa.int64())
            valid = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, n)), False).to_numpy(zero_copy_only=False)
            ids, doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[valid], np.repeat(np.arange(len(sizes)), sizes)[valid]
            begin = np.searchsorted(doc, np.arange(len(sizes) + 1))
            ids = ids.copy()
            ids[begin[:-1][begin[:-1] < begin[1:]]] += n
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), both.take(pa.array(ids))), b"")
            try:
                texts = joined.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no characters
                texts = pa.array([t.decode("utf-8", "replace") for t in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], names=["row", "text"])

    names, row = _kept(encoded, keep, "text")
    rows = encoded.select(row, F.col("ids").cast("array<int>").alias("ids"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)], "text")
