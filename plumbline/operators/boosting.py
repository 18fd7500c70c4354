"""Gradient boosting of second order: trees grown on sums of gradients and Hessians.

Every feature is cut into at most 255 bins once. A scan of the binned rows adds up gradient, Hessian and
count per (tree, open node, feature, bin); one shuffle brings the bins of a feature together, running
sums give every split's gain, and the best split of each node goes to the driver: a handful of numbers
per node, however many rows there are. All classes of a round grow in the same scans.

Trees grow by level (``max_leaves`` 0), or by leaf: the leaf with the largest gain is split next until
there are ``max_leaves``. Growth by leaf needs a scan only where a chosen leaf's children are unknown,
and such a scan looks at the children of all leaves that the known gains would choose.

The scores of the rows so far are kept with the rows, so a round costs the same however many came before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from plumbline.functions.parts import spread
from plumbline.functions.scratch import materialize

MAX_BINS = 255
# Cells (node, feature, bin) that one scan may hold in a task; more open nodes take further scans.
SCAN_CELLS = 4_000_000
# Columns whose cuts are found in one aggregation, and rounds after which the scores are written.
CUT_COLUMNS = 100
WRITTEN_ROUNDS = 10

_CELL = pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())])
_CELL_SQL = "slot int, feature int, bin int, g double, h double, n long"
_SCORED = T.StructType([T.StructField("prediction", T.DoubleType()), T.StructField("probability", T.ArrayType(T.DoubleType()))])


@dataclass
class Tree:
    """Nodes as parallel lists; ``feature`` is -1 at a leaf, a row goes left if its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = first, first + 1
        for value in values:
            for column, start in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0)):
                column.append(start)
        return first, first + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        feature, cut, left, right = (np.asarray(c) for c in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[node] >= 0).any():
            f = np.maximum(feature[node], 0)
            onward = np.where(bins[rows, f] <= cut[node], left[node], right[node])
            node = np.where(inner, onward, node)
        return node


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: ``rounds`` holds one tree per class and round."""

    cuts: list[np.ndarray]
    base: np.ndarray
    rounds: list[list[Tree]]
    objective: str

    @property
    def numClasses(self) -> int:
        return 0 if self.objective == "squared" else max(2, len(self.base))

    @property
    def gains(self) -> list[float]:
        """Share of every feature in the gain of all splits."""
        total = np.zeros(len(self.cuts))
        for trees in self.rounds:
            for tree in trees:
                for f, gain in zip(tree.feature, tree.gain):
                    if f >= 0:
                        total[f] += gain
        return (total / total.sum() if total.sum() else total).tolist()

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += np.asarray(tree.value)[tree.places(bins)]
        return out

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Add ``prediction`` and, for classes, ``probability`` as an array by class."""

        @arrow_udf(_SCORED)
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                scores = self.scores(binned(_matrix(batch, len(self.cuts)), self.cuts))
                if self.objective == "squared":
                    yield pa.StructArray.from_arrays([pa.array(scores[:, 0]), pa.nulls(len(scores), pa.list_(pa.float64()))], fields=_scored_fields())
                    continue
                p = probabilities(scores)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.StructArray.from_arrays([pa.array(p.argmax(axis=1).astype(float)), lists], fields=_scored_fields())

        found = rows.withColumn("_scored", score(vector_to_array(features)))
        classes = {"probability": F.col("_scored.probability")} if self.numClasses else {}
        return found.withColumns({"prediction": F.col("_scored.prediction"), **classes}).drop("_scored")


def _scored_fields() -> list[pa.Field]:
    return [pa.field("prediction", pa.float64()), pa.field("probability", pa.list_(pa.float64()))]


def _matrix(batch: pa.Array, width: int) -> np.ndarray:
    flat = batch.flatten() if isinstance(batch, (pa.ListArray, pa.LargeListArray)) else batch
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(-1, width)


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of the bin of each value: how many cuts lie below it, of which the first is minus infinity. NaN has bin 0."""
    out = np.empty(values.shape, np.uint8)
    for f, edges in enumerate(cuts):
        column = values[:, f]
        out[:, f] = np.where(np.isnan(column), 0, np.searchsorted(edges, column, "left"))
    return out


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Class probabilities of scores: logistic for one column, softmax for more."""
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-scores[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(scores: np.ndarray, label: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of every row's loss by score; of the softmax Hessian twice the diagonal, which bounds it."""
    if objective == "squared":
        return scores - label[:, None], np.ones_like(scores)
    p = probabilities(scores)
    if objective == "logistic":
        return p[:, 1:] - label[:, None], np.maximum(p[:, 1:] * p[:, :1], 1e-16)
    target = np.arange(scores.shape[1])[None, :] == label[:, None]
    return p - target, np.maximum(2 * p * (1 - p), 1e-16)


def feature_cuts(rows: DataFrame, features: Column, width: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` cut values per feature: minus infinity, below which only NaN is, and quantiles over all rows."""
    shares = [(b + 1) / bins for b in range(bins - 1)]
    out: list[np.ndarray] = []
    vectors = rows.select(features.alias("x"))
    for first in range(0, width, CUT_COLUMNS):
        columns = [F.col("x")[f] for f in range(first, min(width, first + CUT_COLUMNS))]
        found = vectors.agg(*[F.percentile_approx(F.when(~F.isnan(c), c), shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns)])
        out += [np.unique([-np.inf, *(v or [])]) for v in found.first()]
    return out


@dataclass(frozen=True)
class Boosting:
    """Parameters of a fit; ``classes`` of three and more need the objective ``softmax``."""

    rounds: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    max_leaves: int = 0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    min_child_rows: int = 1
    min_gain: float = 0.0
    bins: int = MAX_BINS
    objective: str = "squared"
    classes: int = 2

    def fit(self, rows: DataFrame) -> BoostedTrees:
        """Trees for ``rows(features, label)``; labels of classes count from 0. Without rows the model has no trees."""
        known = rows.where(F.col("label").isNotNull()).select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        head = known.agg(F.max(F.size("x")), F.avg("label"), F.count(F.lit(1))).first()
        width, mean = head[0] or 0, head[1]
        if not width:
            return BoostedTrees([], np.zeros(1), [], self.objective)
        cuts = feature_cuts(known, F.col("x"), width, min(self.bins, MAX_BINS))
        model = BoostedTrees(cuts, self._base(known, mean, head[2]), [], self.objective)
        outputs = len(model.base)

        def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = model.base.tobytes()
            for batch in batches:
                bins = binned(_matrix(batch.column(0), width), cuts)
                yield pa.record_batch([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(1), pa.array([start] * len(bins), pa.binary())], names=["bins", "label", "scores"])

        schema = "bins binary, label double, scores binary"
        state = materialize(spread(known, head[2]).mapInArrow(prepared, schema)).persist()
        for number in range(self.rounds):
            trees = self._grown(state, width, outputs)
            model.rounds.append(trees)

            def scored(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bins, _, scores = _state(batch, width, outputs)
                    scores = scores.copy()
                    for k, tree in enumerate(trees):
                        scores[:, k] += np.asarray(tree.value)[tree.places(bins)]
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in scores], pa.binary())], names=["bins", "label", "scores"])

            if number + 1 == self.rounds or all(t.feature == [-1] for t in trees):
                break
            after = state.mapInArrow(scored, schema)
            if (number + 1) % WRITTEN_ROUNDS:
                after = after.persist()
                after.count()
            else:
                after = materialize(after).persist()
            state.unpersist()
            state = after
        state.unpersist()
        return model

    def _base(self, known: DataFrame, mean: float, count: int) -> np.ndarray:
        if self.objective == "squared":
            return np.array([mean])
        if self.objective == "logistic":
            p = min(max(mean, 1e-6), 1 - 1e-6)
            return np.array([np.log(p / (1 - p))])
        found = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
        return np.log([max(found.get(k, 0) / count, 1e-6) for k in range(self.classes)])

    def _grown(self, state: DataFrame, width: int, outputs: int) -> list[Tree]:
        """The trees of one round."""
        growing = [_Growth(self) for _ in range(outputs)]
        while True:
            wanted = [(k, node) for k, g in enumerate(growing) for node in g.wanted()]
            if not wanted:
                return [g.finished() for g in growing]
            least = max(1, SCAN_CELLS // (width * (MAX_BINS + 1)))
            for first in range(0, len(wanted), least):
                part = wanted[first : first + least]
                for slot, best in self._scan(state, [g.tree for g in growing], part, width).items():
                    k, node = part[slot]
                    growing[k].known[node] = best

    def _scan(self, state: DataFrame, trees: list[Tree], wanted: list[tuple[int, int]], width: int) -> dict[int, dict]:
        """Best split of every wanted node (class, node), from one scan and one shuffle of cells."""
        by_class: dict[int, np.ndarray] = {}
        for slot, (k, node) in enumerate(wanted):
            by_class.setdefault(k, np.full(len(trees[k].feature), -1))[node] = slot
        objective, outputs = self.objective, len(trees)
        depth = MAX_BINS + 1

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(wanted) * width * depth))
            for batch in batches:
                bins, label, scores = _state(batch, width, outputs)
                g, h = derivatives(scores, label, objective)
                for k, slots in by_class.items():
                    slot = slots[trees[k].places(bins)]
                    there = slot >= 0
                    if not there.any():
                        continue
                    at = (slot[there, None] * width + np.arange(width)[None, :]) * depth + bins[there]
                    for row, weight in enumerate((g[there, k], h[there, k], np.ones(int(there.sum())))):
                        sums[row] += np.bincount(at.ravel(), np.repeat(weight, width), sums.shape[1])
            filled = np.nonzero(sums[2])[0]
            for a in range(0, len(filled), 1 << 16):
                cell = filled[a : a + (1 << 16)]
                columns = [cell // (width * depth), cell // depth % width, cell % depth, sums[0, cell], sums[1, cell], sums[2, cell]]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _CELL)], schema=_CELL)

        summed = state.mapInArrow(cells, _CELL_SQL).repartition("slot", "feature").groupBy("slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        every = Window.partitionBy("slot", "feature")
        upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sides = summed.select(
            "slot", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(every).alias(c) for c in "ghn"]
        )
        gl, hl, nl, g, h, n = (F.col(c) for c in ("gl", "hl", "nl", "g", "h", "n"))

        def worth(g: Column, h: Column) -> Column:
            return g * g / (h + F.lit(self.reg_lambda))

        allowed = (nl >= self.min_child_rows) & (n - nl >= self.min_child_rows) & (n > nl) & (hl >= self.min_child_weight) & (h - hl >= self.min_child_weight)
        gain = F.when(allowed, (worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)) / 2).otherwise(-1.0)
        order = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), *sides.columns)
        best = sides.select("slot", order.alias("best")).groupBy("slot").agg(F.max("best").alias("best"))
        return {r["slot"]: r["best"].asDict() for r in best.collect()}


def _state(batch: pa.RecordBatch, width: int, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    scores = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, outputs)
    return bins, batch.column(1).to_numpy(zero_copy_only=False), scores


class _Growth:
    """One tree while it grows: every node with a known split may have its children made before it is chosen."""

    def __init__(self, parameters: Boosting):
        self.parameters, self.tree, self.known = parameters, Tree(), {}
        self.depth, self.made = {0: 0}, {}  # children of nodes, chosen or not

    def _splittable(self, node: int) -> bool:
        best = self.known.get(node)
        return best is not None and best["gain"] > max(self.parameters.min_gain, 1e-12) and (not self.parameters.max_depth or self.depth[node] < self.parameters.max_depth)

    def _chosen(self) -> tuple[list[int], list[int]]:
        """Nodes to split, in order, and leaves whose best split is unknown, as far as gains are known."""
        p, chosen, unknown = self.parameters, [], []
        queue: list[tuple[float, int]] = []

        def offer(node: int) -> None:
            if p.max_depth and self.depth[node] >= p.max_depth:
                return
            if node not in self.known:
                unknown.append(node)
            elif self._splittable(node):
                heapq.heappush(queue, (-self.known[node]["gain"], node))

        offer(0)
        while queue and (not p.max_leaves or len(chosen) + 1 < p.max_leaves):
            node = heapq.heappop(queue)[1]
            chosen.append(node)
            for child in self._children(node):
                offer(child)
        return chosen, unknown

    def _children(self, node: int) -> tuple[int, int]:
        if node not in self.made:
            best, p = self.known[node], self.parameters
            weigh = lambda g, h: -p.learning_rate * g / (h + p.reg_lambda)
            values = weigh(best["gl"], best["hl"]), weigh(best["g"] - best["gl"], best["h"] - best["hl"])
            self.made[node] = self.tree.split(node, best["feature"], best["bin"], best["gain"], values)
            for child in self.made[node]:
                self.depth[child] = self.depth[node] + 1
        return self.made[node]

    def wanted(self) -> list[int]:
        """Nodes that the next scan must look at; none once the choice can't change any more."""
        chosen, unknown = self._chosen()
        if 0 in self.known and not self.made and not chosen:
            best = self.known[0]
            self.tree.value[0] = -self.parameters.learning_rate * best["g"] / (best["h"] + self.parameters.reg_lambda)
        return unknown

    def finished(self) -> Tree:
        """The tree of the chosen nodes only, numbered anew."""
        chosen, _ = self._chosen()
        keep, out, stack = set(chosen), Tree(), [(0, 0)]
        out.value[0] = self.tree.value[0]
        while stack:
            node, new = stack.pop()
            if node in keep:
                children = self.made[node]
                made = out.split(new, self.tree.feature[node], self.tree.cut[node], self.tree.gain[node], tuple(self.tree.value[c] for c in children))
                stack += zip(children, made)
        return out


# The two growth rules with the usual defaults of second-order boosting.
DEPTH6 = {"learning_rate": 0.3, "max_depth": 6, "reg_lambda": 1.0, "min_child_weight": 1.0}
LEAVES31 = {"learning_rate": 0.1, "max_depth": 0, "max_leaves": 31, "reg_lambda": 0.0, "min_child_weight": 1e-3, "min_child_rows": 20}
