"""A hidden Markov language model over word classes, trained by Baum-Welch on the whole corpus.

The exact count of every training token is taken first. The ``HEAD`` most frequent tokens are classes
of their own; every other token belongs to one of ``TAIL`` classes, told by its last characters. The
probability of a token in a state is that of its class in the state times its share of the class, which
is add-one smoothed over the class's training tokens and one unknown token. Unlike transition and class
tables, whose size is fixed, the counts are never broadcast whole: only the ``SHIPPED`` most frequent go
to the tasks, and all rarer tokens meet their counts in a join.

Baum-Welch passes over all training documents ``ROUNDS`` times, however many they are; each round adds up
expected counts of the partitions.

Texts run side by side as vectors. Those above ``SEGMENT`` classes are cut into segments, which run side by
side too: the matrices of a text's segments are chained first, which tells the vector that enters each of
them, so that the scaled forward recursion is exact over the whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plumbline.functions.scratch import scratch_path

STATES = 6
HEAD = 8_192
TAIL = 1_024
END = HEAD + TAIL  # the class of the end token
CLASSES = END + 1
SHIPPED = 100_000
SEGMENT = 1024
SCALED = 8
BATCH_CLASSES = 1 << 20  # a call per column costs as much as the sums over some hundred rows
SUMMED = 1 << 16
ADD = np.ones((STATES, STATES))  # times this, every value of a line becomes the line's sum
ROUNDS = 14
BLOCK = 1024  # expected counts in a row of the sums over partitions
FLUSH_TOKENS = 200_000
SEED = 7


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between blanks, A-Z lower-cased: the different ones, per word its number among them, and the words of each text."""
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"").take(pa.array(np.arange(len(texts))))  # ascii_lower fails in the midst of a buffer
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole.view(pa.large_string())))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = np.nonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))[0]  # before and after outer blanks
    if len(empty):
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
        sizes -= np.bincount(np.searchsorted(np.cumsum(sizes), empty, side="right"), minlength=len(sizes))
    coded = words.dictionary_encode()
    return coded.dictionary.view(pa.large_binary()).cast(pa.binary()), coded.indices.to_numpy(), sizes


def tail_class(token: bytes) -> int:
    return HEAD + zlib.crc32(token[-3:]) % TAIL


def tail_classes(tokens: pa.Array) -> np.ndarray:
    """The tail class of every token; equal endings are looked at once."""
    endings = pc.binary_slice(tokens, -3).dictionary_encode()
    return np.array([tail_class(x) for x in endings.dictionary.to_pylist()], np.int64)[endings.indices.to_numpy()]


def token_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(token, n)`` over all rows. Tasks add up before the shuffle and hold a bounded table meanwhile."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in batches:
            tokens, numbers, _ = tokens_of(batch.column(0))
            times = pa.array(np.bincount(numbers, minlength=len(tokens)), pa.int64())
            held.append(pa.table({"token": tokens, "n": times}))
            if sum(map(len, held)) > FLUSH_TOKENS:
                held = [added()]
                if len(held[0]) > FLUSH_TOKENS:
                    yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    partial = texts.select(F.col(column).cast("binary").alias("text")).mapInArrow(count, "token binary, n long")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows: the frequent tokens with counts, and totals of the tail classes."""

    counts: dict[bytes, int]  # the most frequent tokens, by falling count
    classes: dict[bytes, int]
    tail_total: np.ndarray  # training tokens of each tail class
    tail_kinds: np.ndarray  # distinct training tokens of each tail class
    ends: int
    total: int
    kinds: int

    def base(self, count: int) -> float:
        return math.log10((count + 1) / (self.total + self.kinds + 1))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent tokens by falling count: as many whole steps of a fine count scale as fit into ``most``.

    The scale has some thousand steps at most, so nothing is sorted and no task sends a list of its own.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    lowest, room = None, most
    for s, k in sizes:
        if k > room:
            break
        lowest, room = s, room - k
    if lowest is None:
        return {}
    rows = counts.where(step >= lowest).collect()  # ``most`` rows at most
    return dict(sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0])))


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """Bounded statistics of the counts: at most ``SHIPPED`` tokens and one row per tail class."""
    known = frequent(counts, SHIPPED)
    classes = {token: i for i, token in enumerate(known) if i < HEAD}
    ending = F.substring("token", -3, 3)
    by_class = counts.groupBy((F.crc32(ending) % TAIL).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    total, kinds = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in by_class.collect():
        total[r["c"]], kinds[r["c"]] = r["n"], r["k"]
    words, distinct = int(total.sum()), int(kinds.sum())
    for token in classes:  # head tokens are no part of the tail
        total[tail_class(token) - HEAD] -= known[token]
        kinds[tail_class(token) - HEAD] -= 1
    has_end = 1 if documents else 0
    return Vocabulary(known, classes, total, kinds, documents, words + documents, distinct + has_end)


SEQUENCE = T.StructType(
    [
        T.StructField("classes", T.BinaryType()),  # little-endian uint16
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),  # among the shipped tokens
        T.StructField("base", T.DoubleType()),  # of the shipped tokens
        T.StructField("shares", T.DoubleType()),
        T.StructField(
            "rare",
            T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.IntegerType())])),
        ),
    ]
)


def sequences(text: Column, shipped: Broadcast) -> Column:
    """Class sequence of a text with its end, sums over shipped tokens, and the rare tokens with their numbers."""

    @arrow_udf(SEQUENCE)
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v: Vocabulary = shipped.value
        numbered = pa.array(list(v.counts), pa.binary())
        # By number; the last place is that of all rare tokens.
        classes = np.array([v.classes.get(t, -1) for t in v.counts] + [-1])
        tails = np.array([tail_class(t) for t in v.counts] + [0])
        counts = np.array([*v.counts.values(), 0], float)
        base = np.log10((counts + 1) / (v.total + v.kinds + 1))
        mass = (v.tail_total + v.tail_kinds + 1)[np.maximum(tails - HEAD, 0)]
        shares = np.where(classes < 0, np.log10((counts + 1) / mass), 0.0)
        classes = np.where(classes < 0, tails, classes).astype("<u2")
        base[-1] = shares[-1] = 0.0
        end_base, end_known = v.base(v.ends), int(v.ends > 0)
        for batch in batches:
            tokens, numbers, sizes = tokens_of(batch)
            found = pc.fill_null(pc.index_in(tokens, numbered), -1).to_numpy(zero_copy_only=False)
            class_of, unknown = classes[found], found < 0
            class_of[unknown] = tail_classes(tokens.filter(pa.array(unknown)))
            row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes + 1)
            sequence = np.full(len(numbers) + len(sizes), END, "<u2")
            sequence[np.arange(len(numbers)) + row] = class_of[numbers]
            rare = np.nonzero(unknown[numbers])[0]
            # Text and token in one number; equal ones of a text are counted.
            pairs, times = np.unique(row[rare] * len(tokens) + numbers[rare], return_counts=True)
            rare_row, rare_token = np.divmod(pairs, max(1, len(tokens)))
            entries = pa.StructArray.from_arrays([tokens.take(pa.array(rare_token)), pa.array(times, pa.int32())], names=["token", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare_row, np.arange(len(sizes) + 1)), pa.int32()), entries)
            offsets = np.append(0, 2 * ends)
            if offsets[-1] >= 1 << 31:
                raise ValueError("a batch of texts has too many tokens for one Arrow column")
            binary = pa.BinaryArray.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(sequence)]
            )
            plain = [
                binary,
                pa.array(sizes + 1, pa.int64()),
                pa.array(sizes - np.bincount(row[rare], minlength=len(sizes)) + end_known, pa.int64()),
                pa.array(np.bincount(row, weights=base[found][numbers], minlength=len(sizes)) + end_base, pa.float64()),
                pa.array(np.bincount(row, weights=shares[found][numbers], minlength=len(sizes)), pa.float64()),
            ]
            yield pa.StructArray.from_arrays([*plain, lists], names=SEQUENCE.fieldNames())

    return number(text.cast("binary"))


@dataclass
class Model:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states): probability of the class in the state


def first_model() -> Model:
    rng = np.random.default_rng(SEED)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    emit = rng.uniform(0.5, 1.5, (CLASSES, STATES))
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


class Workspace:
    """Arrays that the batches of a task use one after the other: fresh memory costs more than the sums in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def lines(self, name: str, n: int, width: int = STATES, kind: type = np.float64) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty((n, width), kind)
        return self.held[name][:n]


class Batch:
    """Class sequences of some texts, cut into rows of at most ``SEGMENT`` classes that run side by side.

    Rows stand by falling length, so that those that reach a column are always the first ones, and among the
    longest the ``heads``, which other rows of their texts follow, stand first: ``middles`` first, then openers.
    Arrays hold the columns one after the other, and in a column one line of state values for each of its rows.
    Vectors are scaled in every ``SCALED``-th column only, and forward and backward vectors by the same
    numbers, so that their products are probabilities as they are.
    """

    def __init__(self, texts: list[np.ndarray], space: Workspace | None = None):
        self.space = space or Workspace()
        sizes = np.array([len(t) for t in texts], np.int64)
        self.count = -(-sizes // SEGMENT)
        self.first = np.cumsum(self.count) - self.count
        text = np.repeat(np.arange(len(texts)), self.count)
        within = np.arange(len(text)) - self.first[text]
        lengths = np.minimum(SEGMENT, sizes[text] - within * SEGMENT)
        kind = np.where(within == self.count[text] - 1, 2, within == 0)
        self.middles, self.heads = int((kind == 0).sum()), int((kind < 2).sum())
        order = np.lexsort((kind, -lengths))
        self.place = np.empty(len(order), np.int64)  # of each row in the text order
        self.place[order] = np.arange(len(order))
        longest = int(lengths.max(initial=0))
        self.reach = (len(order) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]).tolist()
        at = np.cumsum([0, *self.reach])  # where each column begins
        self.at = at.tolist()
        self.end = at[lengths[order] - 1] + np.arange(len(order))  # the last place of each row
        self.classes = self.space.lines("classes", self.at[-1], 1, np.uint16)[:, 0]
        if texts:
            target = np.concatenate([at[:n] for n in lengths.tolist()])
            target += np.repeat(self.place, lengths)
            self.classes[target] = np.concatenate(texts)
        self.opening = np.zeros(len(order), bool)  # rows that begin a text
        self.opening[self.place[self.first]] = True

    def emissions(self, model: Model) -> np.ndarray:
        out = self.space.lines("emissions", len(self.classes))
        return model.emit.take(self.classes, axis=0, mode="clip", out=out)

    def ends(self, model: Model, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled vectors at the end of the openers, and of the middle rows the matrices from the vector
        that enters them to that at their end."""
        middles, openers = self.middles, self.heads - self.middles

        def parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.empty((middles * STATES + openers, STATES))
            return x, x[: middles * STATES].reshape(STATES, middles, STATES), x[middles * STATES :]

        now, other = parts(), parts()
        now[1][:], now[2][:] = np.eye(STATES)[:, None], model.start
        for k in range(SEGMENT):
            if k:
                np.dot(now[0], model.move, out=other[0])
                now, other = other, now
            _, matrices, vectors = now
            here = emissions[self.at[k] : self.at[k] + self.heads]
            matrices *= here[:middles]
            vectors *= here[middles:]
            if k % SCALED == SCALED - 1:
                matrices /= matrices.sum(axis=0) @ ADD
                vectors /= vectors @ ADD
        return now[2], now[1].transpose(1, 0, 2).copy()

    def chain(self, model: Model, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row the vector at the end of the row before it and the vector that enters it, and the matrices of the middle rows."""
        n = len(self.place)
        before, entering = np.zeros((n, STATES)), np.repeat(model.start[None], n, axis=0)
        if not self.heads:
            return before, entering, np.empty((0, STATES, STATES))
        state, matrices = self.ends(model, emissions)
        texts = np.nonzero(self.count > 1)[0]
        for step in range(1, int(self.count.max())):
            goes_on = self.count[texts] > step
            texts, state = texts[goes_on], state[goes_on]
            row = self.place[self.first[texts] + step]
            before[row] = state / state.sum(axis=1, keepdims=True)
            entering[row] = before[row] @ model.move
            inner = step < self.count[texts] - 1
            texts, row = texts[inner], row[inner]
            state = (entering[row][:, None, :] @ matrices[row])[:, 0]
        return before, entering, matrices

    def following(self, model: Model, ahead: np.ndarray, matrices: np.ndarray) -> np.ndarray:
        """Per head the scaled probability of what follows it, by its last state; ``ahead`` tells that of last rows."""
        follows, after = np.empty((len(self.place), STATES)), np.empty((self.heads, STATES))
        follows[self.heads :] = ahead[self.heads : len(self.place)]
        for step in reversed(range(1, int(self.count.max()))):
            texts = np.nonzero(self.count > step)[0]
            last, row = self.place[self.first[texts] + step - 1], self.place[self.first[texts] + step]
            returned = follows[row] @ model.move.T
            after[last] = returned / returned.max(axis=1, keepdims=True)
            if step > 1:  # the last row before this one is a middle row
                follows[last] = (matrices[last] @ after[last][:, :, None])[:, :, 0]
        return after

    def forward(self, model: Model, emissions: np.ndarray, entering: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Scaled forward vectors of all places, the scales of scaled columns, and the log scale of each row."""
        states, scales, logs = self.space.lines("states", len(self.classes)), {}, np.zeros(len(self.place))
        last = 0
        for k, m in enumerate(self.reach):
            at = self.at[k]
            here = states[at : at + m]
            if k:
                np.dot(states[last : last + m], model.move, out=here)
                here *= emissions[at : at + m]
            else:
                np.multiply(entering, emissions[:m], out=here)
            if k % SCALED == SCALED - 1:
                scales[k] = here @ ADD
                here /= scales[k]
                logs[:m] += np.log(scales[k][:, 0])
            last = at
        return states, scales, logs + np.log(states[self.end].sum(axis=1))

    def backward(self, model: Model, emissions: np.ndarray, scales: dict[int, np.ndarray], back: np.ndarray, low: int, high: int):
        """Rows from ``low`` to ``high``: each place's emissions times what follows it, where the emissions were.

        ``back`` has what follows the rows and gets what follows their first places.
        """
        turned = np.ascontiguousarray(model.move.T)
        for k in reversed(range(len(self.reach))):
            m = min(self.reach[k], high)
            if m <= low:
                continue
            ahead, after = emissions[self.at[k] + low : self.at[k] + m], back[low:m]
            ahead *= after
            if k in scales:
                ahead /= scales[k][low:m]
            if k:
                np.dot(ahead, turned, out=after)

    def likelihoods(self, model: Model) -> np.ndarray:
        """Log likelihood of every text, exact over its whole length."""
        emissions = self.emissions(model)
        logs = self.forward(model, emissions, self.chain(model, emissions)[1])[2]
        return np.add.reduceat(logs[self.place], self.first) if len(self.first) else logs

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and class emissions of one pass forward and back."""
        ahead, n = self.emissions(model), len(self.place)
        before, entering, matrices = self.chain(model, ahead)
        states, scales, _ = self.forward(model, ahead, entering)
        # Last rows come first: what they tell goes back over the matrices to the heads.
        back = 1 / (states[self.end] @ ADD)
        self.backward(model, ahead, scales, back, self.heads, n)
        if self.heads:
            after = self.following(model, ahead, matrices)
            back[: self.heads] = after / ((states[self.end[: self.heads]] * after) @ ADD)
            self.backward(model, ahead, scales, back, 0, self.heads)
        starts = (states[:n] * back)[self.opening].sum(axis=0)
        moves, some = before.T @ ahead[:n], np.empty((STATES, STATES))  # before is 0 for the rows that begin a text
        for k, m in enumerate(self.reach[1:], 1):
            last, at = self.at[k - 1], self.at[k]
            moves += np.dot(states[last : last + m].T, ahead[at : at + m], out=some)
        for k, size in scales.items():
            ahead[self.at[k] : self.at[k] + len(size)] *= size
        # State probabilities times the emission, which is the same for all places of a class.
        emits = np.zeros((STATES, CLASSES))
        for i in range(0, len(self.classes), SUMMED):
            here = slice(i, i + SUMMED)
            ahead[here] *= states[here]
            classes, weights = self.classes[here].astype(np.int64), ahead[here].T.copy()
            for state in range(STATES):
                emits[state] += np.bincount(classes, weights=weights[state], minlength=CLASSES)
        return starts, moves * model.move, emits.T / model.emit


def _batches(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sequences of an Arrow column by falling length in groups of bounded and about equal size, with their
    places in the column (a longer text is a group by itself)."""
    texts = [np.frombuffer(value.as_py(), "<u2") for value in column]
    sizes = np.array([len(t) for t in texts], np.int64)
    order, whole = np.argsort(-sizes, kind="stable"), int(sizes.sum())
    share = whole / max(1, -(-whole // BATCH_CLASSES))
    begin, size = 0, 0
    for i, n in enumerate(sizes[order].tolist()):
        if i > begin and (size >= share or size + n > BATCH_CLASSES):
            yield order[begin:i], [texts[j] for j in order[begin:i]]
            begin, size = i, 0
        size += n
    if begin < len(order):
        yield order[begin:], [texts[j] for j in order[begin:]]


def round_counts(training: DataFrame, model: Broadcast) -> np.ndarray:
    """Expected counts of one Baum-Welch round as one vector; partitions send one row per block of it, added in the cluster."""
    width = STATES + STATES * STATES + CLASSES * STATES

    def rows_of(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        values = [pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=["block", "x"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, space = np.zeros(width), Workspace()
        for batch in batches:
            for _, texts in _batches(batch.column(0)):
                total += np.concatenate([x.ravel() for x in Batch(texts, space).expected(model.value)])
        parts = {i // BLOCK: total[i : i + BLOCK] for i in range(0, width, BLOCK)}
        yield rows_of({i: x for i, x in parts.items() if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = sums.get(block, 0.0) + np.frombuffer(x.as_py())
        yield rows_of(sums)

    form = "block int, x binary"
    added = training.select("classes").mapInArrow(collect, form).repartition("block").mapInArrow(add, form)
    out = np.zeros(width)
    for r in added.collect():  # one row per block
        x = np.frombuffer(r["x"])
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return out


def improved(counts: np.ndarray) -> Model:
    """The model that the expected counts call for; a little smoothing keeps every probability above 0."""
    starts, moves, emits = np.split(counts, [STATES, STATES + STATES * STATES])
    start, move, emit = starts + 0.1, moves.reshape(STATES, STATES) + 0.1, emits.reshape(CLASSES, STATES) + 1e-3
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def fit(training: DataFrame) -> Model:
    """Baum-Welch over ``training(classes)``: every round takes all sequences."""
    context, model = training.sparkSession.sparkContext, first_model()
    if training.isEmpty():
        return model
    for _ in range(ROUNDS):
        shipped = context.broadcast(model)
        model = improved(round_counts(training, shipped))
        shipped.unpersist()
    return model


def likelihood(classes: Column, model: Broadcast) -> Column:
    """log10 of the exact probability of class sequences, by the scaled forward recursion."""

    @arrow_udf(T.DoubleType())
    def forward(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        space = Workspace()
        for batch in batches:
            logs = np.empty(len(batch))
            for places, texts in _batches(batch):
                logs[places] = Batch(texts, space).likelihoods(model.value)
            yield pa.array(logs / math.log(10), pa.float64())

    return forward(classes)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and the model's score.

    NULL text counts as empty: one token, the end. Learns from the rows that are not held out and runs
    its jobs while it is called; class sequences and counts are written to the shared scratch folder.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts_path, rows_path = scratch_path(spark, "token-counts"), scratch_path(spark, "sequences")
    token_counts(training).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    v = vocabulary(counts, training.count())
    shipped = context.broadcast(v)
    numbered = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", sequences(F.col("text"), shipped).alias("s")
    )
    numbered.select("row", "doc_id", "held_out", "s.*").write.parquet(rows_path)  # fixes the row numbers
    staged = spark.read.parquet(rows_path)
    model = context.broadcast(fit(staged.where(~F.col("held_out")).select("classes")))

    # Rare tokens, whose counts are not shipped, meet them in a join: none of them is a hot key.
    rare = staged.select("row", F.inline("rare")).join(counts.withColumnRenamed("n", "c"), "token", "left")
    c = F.coalesce("c", F.lit(0))
    place = (F.crc32(F.substring("token", -3, 3)) % TAIL).cast("int") + 1
    mass = F.element_at(F.array(*[F.lit(int(a + b + 1)) for a, b in zip(v.tail_total, v.tail_kinds)]), place)
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("r_known"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(v.total + v.kinds + 1))).alias("r_base"),
        F.sum(F.col("n") * F.log10((c + 1) / mass)).alias("r_shares"),
    )
    zero = F.lit(0.0)
    return (
        staged.drop("rare")
        .withColumn("hmm", likelihood(F.col("classes"), model))
        .drop("classes")
        .join(sums, "row", "left")
        .select(
            F.col("doc_id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
            F.lit(v.total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"),
            (F.col("hmm") + F.col("shares") + F.coalesce("r_shares", zero)).alias("score"),
        )
    )
