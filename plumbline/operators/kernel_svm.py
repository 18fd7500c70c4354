"""Support-vector classification with a radial kernel and calibrated probabilities.

The kernel ``exp(-gamma |x - y|^2)`` is the expectation of a product of cosines over random directions,
so a linear machine on such cosines separates what the kernel machine separates, and its cost grows
with the rows, not with their pairs. Directions come from a seed and are part of the model; one task
of rows turns into one matrix product.

The hinge loss is minimised by summed subgradient statistics of Spark's linear machine. A sigmoid over
its margins turns them into probabilities: two numbers fitted by Newton steps, each of which is one
aggregation over the margins of a hash fold that the machine was not fitted on, for every fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from plumbline.functions.scratch import materialize

SEED = 42


@dataclass(frozen=True)
class RandomCosines:
    """``x`` to ``sqrt(2 / n) cos(W x + b)``; the mean of the products approaches the kernel as n grows."""

    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def drawn(width: int, gamma: float, count: int, seed: int = SEED) -> RandomCosines:
        rng = np.random.default_rng(seed)
        return RandomCosines(rng.normal(size=(width, count)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, count))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.cos(x @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))

    def column(self, features: Column) -> Column:
        """Vector column of the cosines of a vector column."""
        width = len(self.directions)

        @arrow_udf(T.ArrayType(T.DoubleType()))
        def cosines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = np.asarray(batch.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
                out = self.of(x)
                ends = pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32())
                yield pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

        return array_to_vector(cosines(vector_to_array(features)))


def scale_gamma(rows: DataFrame, width: int) -> float:
    """One over the number of entries times the variance of all entries together, in one aggregation."""
    x = vector_to_array("features")
    sums = rows.agg(
        F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)), F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)), F.count(F.lit(1))
    ).first()
    entries = (sums[2] or 0) * width
    variance = sums[1] / entries - (sums[0] / entries) ** 2 if entries else 0.0
    return 1 / (width * variance) if variance > 0 else 1.0


def sigmoid(margins: DataFrame, steps: int = 50) -> tuple[float, float]:
    """``(a, b)`` of ``P(label 1) = 1 / (1 + exp(a m + b))`` for ``margins(m, label)``.

    Newton's method on the log-loss with targets ``(n1 + 1) / (n1 + 2)`` and ``1 / (n0 + 2)`` instead of
    1 and 0; a step is one aggregation of six sums, halved until the loss falls.
    """
    counts = margins.agg(F.sum("label"), F.count(F.lit(1))).first()
    ones, zeros = float(counts[0] or 0), float((counts[1] or 0) - (counts[0] or 0))
    high, low = (ones + 1) / (ones + 2), 1 / (zeros + 2)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    m = F.col("m")

    def sums(a: float, b: float):
        z = F.lit(a) * m + F.lit(b)
        p = 1 / (1 + F.exp(z))
        # log(1 + exp(z)) without overflow, either way round.
        loss = target * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        d, w = target - p, p * (1 - p)
        return margins.agg(F.sum(loss), F.sum(d * m), F.sum(d), F.sum(w * m * m), F.sum(w * m), F.sum(w)).first()

    a, b = 0.0, math.log((zeros + 1) / (ones + 1))
    if not counts[1]:
        return a, b
    now = sums(a, b)
    for _ in range(steps):
        loss, ga, gb, haa, hab, hbb = now
        haa, hbb = haa + 1e-12, hbb + 1e-12
        if abs(ga) < 1e-5 and abs(gb) < 1e-5:
            break
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        size, slope = 1.0, ga * da + gb * db
        while size >= 1e-10:
            after = sums(a + size * da, b + size * db)
            if after[0] < loss + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        a, b, now = a + size * da, b + size * db, after
    return a, b


@dataclass(frozen=True)
class KernelMachine:
    """A fitted machine: cosines, a linear margin over them and the sigmoid of the margin."""

    cosines: RandomCosines
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float
    numClasses: int = 2

    def margin(self, features: Column) -> Column:
        parts = F.zip_with(vector_to_array(self.cosines.column(features)), F.array(*[F.lit(float(w)) for w in self.weights]), lambda z, w: z * w)
        return F.aggregate(parts, F.lit(self.intercept), lambda total, v: total + v)

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Add ``margin``, ``probability`` (an array by class) and ``prediction``, the side of the margin."""
        one = 1 / (1 + F.exp(F.lit(self.slope) * F.col("margin") + F.lit(self.shift)))
        scored = rows.withColumn("margin", self.margin(F.col(features)))
        return scored.withColumns({"probability": F.array(1 - one, one), "prediction": (F.col("margin") > 0).cast("double")})


@dataclass(frozen=True)
class KernelSVC:
    """Parameters of a fit: ``cost`` weighs the hinge loss of a row, ``gamma`` None follows the features' variance."""

    cost: float = 1.0
    gamma: float | None = None
    cosines: int = 500
    folds: int = 3
    max_iter: int = 50
    tolerance: float = 1e-4
    seed: int = SEED

    def _machine(self, rows: DataFrame, count: int):
        penalty = 1 / (self.cost * max(count, 1))
        return LinearSVC(featuresCol="z", maxIter=self.max_iter, tol=self.tolerance, regParam=penalty, standardization=False).fit(rows)

    def fit(self, rows: DataFrame) -> KernelMachine:
        """A machine for ``rows(features, label)`` with labels 0 and 1.

        Rows of equal features fall into the same fold, so no margin of the sigmoid comes from a machine
        that has seen the row. Rows of one label only give a machine without direction.
        """
        known = rows.where(F.col("label").isNotNull()).select("features", F.col("label").cast("double").alias("label"))
        width = (known.agg(F.max(F.size(vector_to_array("features")))).first()[0]) or 0
        gamma = self.gamma or (scale_gamma(known, width) if width else 1.0)
        cosines = RandomCosines.drawn(width, gamma, self.cosines, self.seed)
        fold = F.pmod(F.xxhash64(vector_to_array("features")), F.lit(self.folds)).cast("int")
        prepared = materialize(known.select(fold.alias("fold"), cosines.column(F.col("features")).alias("z"), "label")).persist()
        by_label = {r["label"]: r["count"] for r in prepared.groupBy("label").count().collect()}
        if len(by_label) < 2:
            prepared.unpersist()
            side = 1.0 if by_label.get(1.0) else -1.0
            n = sum(by_label.values())
            p = ((n if side > 0 else 0) + 1) / (n + 2)
            return KernelMachine(cosines, np.zeros(self.cosines), side, 0.0, math.log((1 - p) / p))
        machine = self._machine(prepared, prepared.count())
        margins = None
        for k in range(self.folds):
            seen = prepared.where(F.col("fold") != k)
            if seen.select("label").distinct().count() < 2:
                continue
            part = self._machine(seen, seen.count()).transform(prepared.where(F.col("fold") == k))
            part = part.select(vector_to_array("rawPrediction")[1].alias("m"), "label")
            margins = part if margins is None else margins.unionByName(part)
        slope, shift = sigmoid(materialize(margins)) if margins is not None else (-1.0, 0.0)
        prepared.unpersist()
        return KernelMachine(cosines, machine.coefficients.toArray(), float(machine.intercept), slope, shift)
