"""Text quality by a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from features of its own and of the lines beside it, and from the
labels beside it. A document's score is the mean of the lines' forward-backward marginals for good,
weighted by line length; a logistic curve over that mean, fitted last, makes it the probability of a
good document (a document with some good lines among bad ones is rarely labelled good).

Training takes a bounded sample of labelled documents (``SAMPLE_DOCUMENTS``, the first by a hash of the
id); each of their lines carries the document's label. Features of the sample stay on the cluster: a
step of the optimizer is one job that adds up gradients, of which only the sum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plumbline.functions.scratch import materialize

SAMPLE_DOCUMENTS = 6_000
STEPS = 25
RIDGE = 1e-3
THRESHOLD = 0.3
BATCH_LINES = 1 << 15

FEATURES = (
    "present",
    "words",
    "few_words",
    "symbols",
    "bars",
    "shouts",
    "upper",
    "stutters",
    "distinct",
    "word_length",
    "digits",
    "letters",
    "ends_sentence",
    "seen_before",
    "first",
    "last",
)
WIDTH = 3 * len(FEATURES)  # of the line, the one before, the one after
PARAMETERS = WIDTH + 3  # and the moves bad-good, good-bad, good-good against bad-bad

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"


def lines_of(text: bytes | None) -> list[bytes]:
    """Lines with a visible character; a text without any is one empty line."""
    return [line for line in (text or b"").split(b"\n") if line.strip()] or [b""]


def line_features(lines: list[bytes]) -> np.ndarray:
    """One row of ``WIDTH`` features per line, all about between 0 and 1."""
    seen: set[bytes] = set()
    rows = []
    for i, line in enumerate(lines):
        words = line.split()
        n, size = max(1, len(words)), max(1, len(line))
        letters = size - len(line.translate(None, _LETTERS))
        rows.append(
            (
                1.0,
                min(1.0, len(words) / 64),
                len(words) < 4,
                min(1.0, (size - len(line.translate(None, _SYMBOLS))) / n),
                min(1.0, line.count(b"|") / n),
                min(1.0, line.count(b"!!") / n),
                (size - len(line.translate(None, _UPPER))) / max(1, letters),
                sum(map(eq, words, words[1:])) / n,
                len(set(words)) / n,
                min(1.0, size / n / 20),
                (size - len(line.translate(None, _DIGITS))) / size,
                letters / size,
                line.rstrip()[-1:] in (b".", b"?", b"!"),
                line in seen,
                i == 0,
                i == len(lines) - 1,
            )
        )
        seen.add(line)
    own = np.array(rows, np.float32)
    none = np.zeros((1, own.shape[1]), np.float32)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


@dataclass
class Chains:
    """Lines of some documents, by position; documents stand by falling number of lines."""

    features: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(-self.counts, kind="stable")
        starts = np.cumsum([0, *self.counts])[:-1][self.order]
        lengths = self.counts[self.order]
        reach = [int((lengths > k).sum()) for k in range(int(lengths.max(initial=0)))]
        self.rows = [starts[:m] + k for k, m in enumerate(reach)]

    def marginals(self, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good per line, expected moves (2 x 2), and log of each document's normalizer."""
        weight = np.exp(np.clip(self.features @ parameters[:WIDTH], -30, 30))
        odds = np.stack([np.ones(len(weight)), weight], axis=1)  # bad, good
        move = np.exp(np.array([[0.0, parameters[-3]], [parameters[-2], parameters[-1]]]))
        forward, scale = [], np.zeros(len(self.counts))
        for k, rows in enumerate(self.rows):
            state = odds[rows] if k == 0 else (forward[-1][: len(rows)] @ move) * odds[rows]
            size = state.sum(axis=1, keepdims=True)
            scale[: len(rows)] += np.log(size[:, 0])
            forward.append(state / size)
        good, moves = np.empty(len(weight)), np.zeros((2, 2))
        back = np.ones((len(self.counts), 2))
        for k in reversed(range(len(self.rows))):
            rows = self.rows[k]
            both = forward[k] * back[: len(rows)]
            both /= both.sum(axis=1, keepdims=True)
            good[rows] = both[:, 1]
            if k:
                ahead = odds[rows] * back[: len(rows)]
                left = forward[k - 1][: len(rows)]
                share = left / ((left @ move) * ahead).sum(axis=1, keepdims=True)
                moves += share.T @ ahead
                new = ahead @ move.T
                back[: len(rows)] = new / new.sum(axis=1, keepdims=True)
        total = np.empty(len(self.counts))
        total[self.order] = scale
        return good, moves * move, total

    def gradient(self, parameters: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Loss (minus log likelihood of every line bearing its document's label), gradient, lines."""
        good, moves, total = self.marginals(parameters)
        of_line = np.repeat(labels, self.counts).astype(float)
        signal = np.clip(self.features @ parameters[:WIDTH], -30, 30)
        steps = self.counts - 1
        kept = np.array([steps[labels == 0].sum(), steps[labels == 1].sum()])
        likelihood = (signal * of_line).sum() + parameters[-1] * kept[1] - total.sum()
        slope = self.features.T @ (good - of_line)
        return np.concatenate([[-likelihood], slope, [moves[0, 1], moves[1, 0], moves[1, 1] - kept[1]], [len(good)]])


def minimized(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, steps: int = STEPS) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    x = np.zeros(size)
    value, slope = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, held = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            held.append(a)
            direction -= a * y
        direction *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(pairs, reversed(held)):
            direction += (a - (y @ direction) / (s @ y)) * s
        rate = 1.0
        while True:
            new_value, new_slope = loss(x - rate * direction)
            if new_value <= value or rate < 1e-3:
                break
            rate /= 4
        if new_value > value:
            break
        step, change = -rate * direction, new_slope - slope
        done = value - new_value <= 1e-6 * abs(value)
        x, value, slope = x + step, new_value, new_slope
        if step @ change > 1e-12:
            pairs = [*pairs[-7:], (step, change)]
        if done:
            break
    return x


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", steps: int = STEPS) -> np.ndarray:
    """Parameters from labelled rows (label 0 or 1); all 0 without any, which scores every line 0.5."""

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [line_features(lines_of(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.tobytes() for t in tables], pa.binary()), batch.column(1)], names=["features", "label"]
            )

    rows = labelled.select(F.col(text_col).cast("binary").alias("text"), F.col(label_col).cast("int").alias("label"))
    sample = materialize(rows.mapInArrow(featurize, "features binary, label int").coalesce(8))
    context = labelled.sparkSession.sparkContext

    def loss(parameters: np.ndarray) -> tuple[float, np.ndarray]:
        shipped = context.broadcast(parameters)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(PARAMETERS + 2)
            for batch in batches:
                labels = batch.column(1).to_numpy()
                tables = [np.frombuffer(b.as_py(), np.float32).reshape(-1, WIDTH) for b in batch.column(0)]
                for a, b in _groups([len(t) for t in tables]):
                    chains = Chains(np.vstack(tables[a:b]), np.array([len(t) for t in tables[a:b]]))
                    total += chains.gradient(shipped.value, labels[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

        sums = np.zeros(PARAMETERS + 2)
        for r in sample.mapInArrow(add, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            sums[r["i"]] = r["x"]
        shipped.unpersist()
        lines = max(1.0, sums[-1])
        return sums[0] / lines + RIDGE * (parameters @ parameters), sums[1:-1] / lines + 2 * RIDGE * parameters

    return minimized(loss, PARAMETERS, steps)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive documents with at most ``BATCH_LINES`` lines in all (a longer one alone)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > BATCH_LINES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def scored(text: Column, parameters: Broadcast) -> Column:
    """Score of a text column, 0 to 1; NULL counts as the empty text, one empty line."""

    @arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            lines = [lines_of(t.as_py()) for t in batch]
            for a, b in _groups([len(x) for x in lines]):
                part = lines[a:b]
                counts = np.array([len(x) for x in part])
                good, _, _ = Chains(np.vstack([line_features(x) for x in part]), counts).marginals(parameters.value)
                weight = np.array([len(line) + 1 for x in part for line in x], float)
                starts = np.cumsum([0, *counts])[:-1]
                out.append(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts))
            yield pa.array(np.clip(np.concatenate(out), 0.0, 1.0) if out else [], pa.float64())

    return score(text.cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", limit: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Texts with labels of at most ``limit`` labelled ids that ``learn`` admits, the first by hash.

    The sampled labels are at most ``limit`` small rows, which bounds their broadcast.
    """
    wanted = labels.where(learn & F.col("quality").isin(0, 1)).select(id_col, F.col("quality").cast("int").alias("quality"))
    sample = wanted.orderBy(F.xxhash64(id_col), id_col, "quality").limit(limit)
    return docs.select(id_col, "text").join(F.broadcast(sample), id_col).select("text", "quality")


def calibration(shares: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Intercept and slope of the logistic curve from weighted shares to labels (Newton steps, a little ridge)."""
    x, weight = np.stack([np.ones(len(shares)), shares], axis=1), np.array([0.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ weight)))
        slope = x.T @ (p - labels) + 1e-2 * weight
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        weight = weight - np.clip(np.linalg.solve(curve, slope), -5, 5)
    return float(weight[0]), float(max(0.0, weight[1]))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted, good_share)`` for every row.

    ``held_out`` is an expression over the id; labelled rows that it leaves are learnt from. Runs the
    training jobs while it is called. Without labelled rows the score is a curve of no information.
    """
    learnt = training_sample(docs, labels, ~held_out, id_col)
    shipped = docs.sparkSession.sparkContext.broadcast(fit(learnt))
    # Numbers of the bounded sample only: one share and one label per sampled document.
    pairs = learnt.select(scored(F.col("text"), shipped).alias("share"), "quality").collect()
    intercept, slope = calibration(np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float))
    return (
        docs.select(F.col(id_col), held_out.alias("held_out"), scored(F.col("text"), shipped).alias("good_share"))
        .withColumn("score", 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("good_share")))))
        .select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "good_share")
    )
