"""The kernel machine on shapes that no plane separates, its kernel and its probabilities."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.operators import kernel_svm, modeling


def rings(n, seed, noise=0.1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    radius, angle = 1 + label + rng.normal(size=n) * noise, rng.uniform(0, 2 * np.pi, n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), label


def table_of(spark, x, y):
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, label int").repartition(3)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_products_of_cosines_approach_the_kernel():
    x = np.random.default_rng(1).normal(size=(40, 3))
    z = kernel_svm.RandomCosines.drawn(3, 0.7, 20_000).of(x)
    exact = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.05


@pytest.fixture(scope="module")
def fitted(spark):
    return kernel_svm.KernelSVC(cosines=100, folds=2, max_iter=40).fit(table_of(spark, *rings(1500, 2, 0.35)))


def test_two_rings_are_separated(spark, fitted):
    x, y = rings(5000, 3, 0.35)
    rows = table_of(spark, x, y)
    got = fitted.transform(rows).select("label", "prediction", F.col("probability")[1].alias("p")).toPandas()
    accuracy = (got.label == got.prediction).mean()
    assert accuracy > 0.9
    plane = LinearSVC(maxIter=20).fit(rows).transform(rows)
    assert plane.where("label = prediction").count() / 5000 < 0.65
    # Calibrated: in every fifth of the probabilities the share of label 1 is about their mean.
    got["fifth"] = got.p.rank(method="first").floordiv(1000.01)
    by = got.groupby("fifth").agg(p=("p", "mean"), label=("label", "mean"))
    assert (by.p - by.label).abs().max() < 0.08


def test_sigmoid_is_the_best_fit(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=800) * 2
    y = (rng.uniform(size=800) < 1 / (1 + np.exp(-1.5 * m + 0.5))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y)], "m double, label int")
    a, b = kernel_svm.sigmoid(df)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(a * m + b))
    assert abs((t - p) @ m) < 1e-3 and abs((t - p).sum()) < 1e-3
    assert a == pytest.approx(-1.5, abs=0.3) and b == pytest.approx(0.5, abs=0.3)


def test_one_label_and_no_rows(spark):
    rows = table_of(spark, np.ones((6, 2)), np.ones(6))
    got = kernel_svm.KernelSVC(cosines=10).fit(rows).transform(rows).collect()
    assert {r["prediction"] for r in got} == {1.0} and got[0]["probability"][1] == pytest.approx(7 / 8)
    assert kernel_svm.KernelSVC(cosines=10).fit(rows.limit(0)).slope == 0.0


def test_comparison_has_the_kernel_machine(spark):
    rows = table_of(spark, *rings(400, 5))
    prepared = modeling.Prepared(rows.select("id", "features", "label"), ["a", "b"], ["0", "1"])
    got = modeling.compare(prepared, ["id"], "classification", ["kernel_svm"])
    values = {r["metric"]: r["value"] for r in got.metrics.collect()}
    assert values["accuracy"] > 0.95 and got.predictions.where("score is null").isEmpty()
