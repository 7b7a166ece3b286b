"""Chat formatting: roles are recovered from transcripts by a hidden Markov model, then each turn is rendered.

The hidden state is the speaker's role. What is seen of a turn is a symbol of
line features: the speaker marker that it begins with ("User:", "[assistant]",
"**System:**", "### Human" on a line of its own, ...), a class of length, whether
it asks, how many lines it has, whether its turn is 0. Start, transition and
emission probabilities are smoothed counts over all turns with a known role of the
conversations that training may see; a turn without a forerunner is a start. Viterbi
then finds the likeliest roles from the symbols alone. Rendering drops the marker and
nothing else: a role's name that a hyphen or ">" follows is text.

Viterbi runs in blocks, so a conversation of any length never meets in one task:
turns are dealt by range of (conversation, turn, text, place in the input), so equal
rows are dealt out too; a run of at most `block` turns of one conversation becomes one
max-plus matrix, from each state before it or none to each at its end; runs of those
matrices become one again, until every conversation has one run. Backwards, the
states at the ends of a run fix those inside. Runs are written to the shared
folder between the levels.

Defined results: null and empty texts are turns with symbols of their own; ties
of turn are ordered by text; repeated rows are turns each; null turns come first;
whatever number a conversation begins with, its first row is its start;
rows without a conversation id form one conversation; without any known role all
turns are the first role; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, work_dir, write_table

ROLES = ("system", "user", "assistant")
BLOCK = 256
#: Runs of one conversation that may meet in the last group, where a block is shorter.
LAST = 8
SMOOTH = 0.5
_N = len(ROLES)
#: A speaker marker at a turn's start, which rendering drops: a name and a colon, within brackets or stars too; a name of over two letters in brackets; one as a heading.
_NAMES = "system|user|human|question|assistant|bot|answer"
MARKER = f"^\\s*(?:#+\\s*)?(?:[\\[<(*]*\\s*({_NAMES}|ai|q|a)\\s*[\\])>*]*\\s*:[\\])>*]*\\s*|[\\[<(]+\\s*({_NAMES})\\s*[\\])>]+\\s*|(?<=#)\\s*({_NAMES})[ \\t]*(?:\\n\\s*|$))"


def symbol(text: Column, first: Column) -> Column:
    """What is seen of a turn, as a short string."""
    t = F.coalesce(text, F.lit(""))
    mark = F.lower(F.concat(*[F.regexp_extract(t, f"(?i){MARKER}", k) for k in (1, 2, 3)]))
    size = F.least(F.lit(12), F.floor(F.log2(F.char_length(t) + 1)))
    lines = F.least(F.lit(4), F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))))
    asks = F.contains(t, F.lit("?")).cast("int")
    return F.concat_ws("|", mark, size.cast("int"), lines, asks, first.cast("int"))


def _turns(conversations: DataFrame, id_col: str, turn_col: str, text_col: str, role_col: str | None) -> DataFrame:
    rows = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"), (F.col(role_col) if role_col else F.lit(None).cast("string")).alias("role"))
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # Equal rows may change places, so their place in the input, which deals them out, need not be the same in another run.
    order = [F.col("id"), F.col("turn"), F.xxhash64("text"), F.col("at")]
    return rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(int(n), *order).sortWithinPartitions(*order)


class Model:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: dict[str, np.ndarray], other: np.ndarray):
        self.start, self.step, self.emit, self.other = start, step, emit, other

    def matrix(self, seen: str) -> np.ndarray:
        """Log-probability of a state after another, or (last row) after none, with what is seen."""
        return np.vstack([self.step, self.start]) + self.emit.get(seen, self.other)[None, :]


def fit(conversations: DataFrame, use: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """Counts over all turns that `use` admits. A turn's forerunner is the row with the same conversation and the turn before."""
    rows = conversations.where(F.lit(True) if use is None else use).select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"), F.col(role_col).alias("role"))
    rows = rows.where(F.col("role").isin(*ROLES))
    opens = F.coalesce(F.col("turn") == 0, F.lit(False))
    emitted = rows.groupBy(symbol(F.col("text"), opens).alias("seen"), "role").agg(F.count("*").alias("n")).collect()  # symbols are bounded by their classes
    pairs = rows.select("id", "turn", "role").distinct()
    stepped = pairs.join(pairs.select("id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before")), ["id", "turn"], "left").groupBy("before", "role").agg(F.count("*").alias("n")).collect()
    start, step = np.full(_N, SMOOTH), np.full((_N, _N), SMOOTH)
    for r in stepped:
        (start if r["before"] is None else step[ROLES.index(r["before"])])[ROLES.index(r["role"])] += r["n"]
    table: dict[str, np.ndarray] = {}
    for r in emitted:
        table.setdefault(r["seen"], np.full(_N, SMOOTH))[ROLES.index(r["role"])] += r["n"]
    total = sum(table.values(), np.full(_N, SMOOTH))
    return Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), {k: np.log(v / total) for k, v in table.items()}, np.log(SMOOTH / total))


def through(mats: np.ndarray) -> np.ndarray:
    """The max-plus product of matrices in order; only the first may begin with no state."""
    m = mats[0]
    for x in mats[1:]:
        m = (m[:, :, None] + x[None, :_N]).max(axis=1)
    return m


def between(mats: np.ndarray, entry: int, leave: int | None) -> list[int]:
    """The best states after each matrix, from `entry` (_N: none) before the first to `leave` after the last (or the best); ties to the smaller state."""
    score, back = mats[0][entry], []
    for x in mats[1:]:
        s = score[:, None] + x[:_N]
        back.append(s.argmax(axis=0))
        score = s.max(axis=0)
    states = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


_RUN = "id {kind}, part int, run long, mat array<double>"


def _assign(model, block: int):
    """Turns in order → turns with their part, run, place in it and matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), {"last": object(), "held": 0, "run": -1}
        for batch in batches:
            runs, places, mats = [], [], []
            for key, seen in zip(*(batch.column(c).to_pylist() for c in ("id", "seen")), strict=True):
                if key != state["last"] or state["held"] == block:
                    state |= {"run": state["run"] + 1, "held": 0, "last": key}
                runs.append(state["run"])
                places.append(state["held"])
                mats.append(model.value.matrix(seen).ravel().tolist())
                state["held"] += 1
            out = {c: batch.column(c) for c in ("id", "turn", "text", "role")}
            yield pa.RecordBatch.from_pydict(out | {"part": pa.array([part] * len(runs), pa.int32()), "run": pa.array(runs, pa.int64()), "place": pa.array(places, pa.int32()), "mat": pa.array(mats, pa.list_(pa.float64()))})

    return run


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [through(np.array([x["mat"] for x in sorted(m, key=lambda x: x["place"])]).reshape(-1, _N + 1, _N)).ravel().tolist() for m in batch.column("m").to_pylist()]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("id", "part", "run")} | {"mat": pa.array(out, pa.list_(pa.float64()))})


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states = []
        for m, entry, leave in zip(*(batch.column(c).to_pylist() for c in ("m", "entry", "leave")), strict=True):
            m.sort(key=lambda x: x["place"])
            got = between(np.array([x["mat"] for x in m]).reshape(-1, _N + 1, _N), entry, leave)
            before = [entry, *got[:-1]]
            states.append([{"place": x["place"], "before": b, "state": s} for x, b, s in zip(m, before, got, strict=True)])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("before", pa.int32()), ("state", pa.int32())]))
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("id", "part", "run")} | {"s": pa.array(states, kind)})


def recover_roles(conversations: DataFrame, model: Model, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each turn: its conversation, turn, text, role as given (or null), recovered role and rendered turn."""
    spark = conversations.sparkSession
    short_batches(spark)
    folder, kind = work_dir(spark, "chat"), conversations.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # a row for each symbol, which their classes bound
    opens = F.coalesce(F.col("turn") == 0, F.lit(False))
    turns = _turns(conversations, id_col, turn_col, text_col, role_col).select("id", "turn", "text", "role", symbol(F.col("text"), opens).alias("seen"))
    base = write_table(turns.mapInArrow(_assign(shared, block), f"id {kind}, turn long, text string, role string, part int, run long, place int, mat array<double>"), f"{folder}/turns")
    levels = [base.select("id", "part", "run", "place", "mat")]
    while True:
        runs = levels[-1].groupBy("id", "part", "run").agg(F.collect_list(F.struct("place", "mat")).alias("m"))  # at most `block` each
        runs = write_table(runs.mapInArrow(_product, _RUN.format(kind=kind)), f"{folder}/runs{len(levels)}")
        most, total = runs.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (most or 0) <= max(block, LAST):
            break
        # A next level: runs in order, dealt by range again, to so few tasks that a conversation over all of them has far fewer runs.
        n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * block * block)))
        ordered = runs.repartitionByRange(n, "id", "part", "run").sortWithinPartitions("id", "part", "run")
        levels.append(write_table(ordered.mapInArrow(_regroup(block), f"id {kind}, below_part int, below_run long, part int, run long, place int, mat array<double>"), f"{folder}/level{len(levels)}"))
    top = runs.groupBy("id").agg(F.collect_list(F.struct("part", "run", "mat")).alias("m"))
    top = top.select("id", F.transform(F.array_sort("m"), lambda x, i: F.struct(i.cast("int").alias("place"), x["mat"].alias("mat"), x["part"].alias("part"), x["run"].alias("run"))).alias("m"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("run"), F.lit(_N).alias("entry"), F.lit(None).cast("int").alias("leave"))
    solved_schema = f"id {kind}, part int, run long, s array<struct<place:int,before:int,state:int>>"
    solved = top.mapInArrow(_solve, solved_schema).select("id", F.explode("s").alias("s")).select("id", "s.*")
    where = top.select("id", F.explode("m").alias("m")).select("id", "m.place", "m.part", "m.run")
    ends = where.join(solved, _same("id", where, solved) & (where["place"] == solved["place"])).select(where["id"], "part", "run", F.col("before").alias("entry"), F.col("state").alias("leave"))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        groups = level.groupBy("id", "part", "run").agg(F.collect_list(F.struct("place", "mat")).alias("m"))
        e = ends.select(*[F.col(c).alias(f"e_{c}") for c in ("id", "part", "run")], "entry", "leave")
        met = groups.join(e, groups["id"].eqNullSafe(e["e_id"]) & (groups["part"] == e["e_part"]) & (groups["run"] == e["e_run"]))
        solved = met.select("id", "part", "run", "m", "entry", "leave").mapInArrow(_solve, solved_schema).select("id", "part", "run", F.explode("s").alias("s")).select("id", "part", "run", "s.*")
        if k:
            s = solved.select(*[F.col(c).alias(f"s_{c}") for c in solved.columns])
            got = level.join(s, (level["part"] == s["s_part"]) & (level["run"] == s["s_run"]) & (level["place"] == s["s_place"]))
            ends = got.select("id", F.col("below_part").alias("part"), F.col("below_run").alias("run"), F.col("s_before").alias("entry"), F.col("s_state").alias("leave"))
    s = solved.select(F.col("part").alias("s_part"), F.col("run").alias("s_run"), F.col("place").alias("s_place"), "state")
    got = base.join(s, (base["part"] == s["s_part"]) & (base["run"] == s["s_run"]) & (base["place"] == s["s_place"]))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("state") + 1)
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"(?i){MARKER}", ""))
    return got.select(F.col("id").alias(id_col), F.col("turn").alias(turn_col), F.col("text").alias(text_col), F.col("role").alias("given"), role.alias("role"), F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>\n")).alias("rendered"))


def _same(c: str, a: DataFrame, b: DataFrame) -> Column:
    return a[c].eqNullSafe(b[c])


def _regroup(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, number = TaskContext.get().partitionId(), object(), 0, -1
        for batch in batches:
            runs, places = [], []
            for key in batch.column("id").to_pylist():
                if key != last or held == block:
                    number, held, last = number + 1, 0, key
                runs.append(number)
                places.append(held)
                held += 1
            out = {"id": batch.column("id"), "below_part": batch.column("part"), "below_run": batch.column("run")}
            yield pa.RecordBatch.from_pydict(out | {"part": pa.array([part] * len(runs), pa.int32()), "run": pa.array(runs, pa.int64()), "place": pa.array(places, pa.int32()), "mat": batch.column("mat")})

    return run
