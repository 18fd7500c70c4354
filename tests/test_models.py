import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from plumbline.functions import parts
from plumbline.operators import boosting, cluster, density, metrics, modeling
from plumbline.plans import models_catalog


def test_target_choice():
    assert modeling.choose_target(["a"], ["a"]) == "a"
    assert modeling.choose_target(["a", "target", "b"], ["a", "b"]) == "target"
    assert modeling.choose_target(["a", "Unit Price", "b"], ["a", "Unit Price", "b"]) == "Unit Price"
    assert modeling.choose_target(["a", "b"], ["a", "b"]) == "b"
    assert modeling.choose_target(["c"], []) is None


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 3)) * [1, 3, 0.5]
    y = x @ [2.0, -1.0, 0.0] + 4 + rng.normal(size=120)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))
    return rows.withColumnRenamed("y", "label"), x, y


def coordinate_descent(x, y, l1, l2):
    """Minimise ||y - xb||^2 / 2n + l1 |b| + l2 |b|^2 / 2 on centred data."""
    x, y = x - x.mean(0), y - y.mean()
    n, b = len(y), np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(b)):
            r = y - x @ b + x[:, j] * b[j]
            rho = x[:, j] @ r / n
            b[j] = math.copysign(max(abs(rho) - l1, 0), rho) / (x[:, j] @ x[:, j] / n + l2)
    return b


@pytest.mark.parametrize(
    "name, l1, l2", [("linear", 0, 0), ("ridge", 0, 1.0 / 120), ("lasso", 0.1, 0), ("elastic_net", 0.5, 0.5)]
)
def test_penalties_match_direct_solution(linear, name, l1, l2):
    rows, x, y = linear
    model = modeling.regression_models(rows)[name].fit(rows)
    np.testing.assert_allclose(model.coefficients.toArray(), coordinate_descent(x, y, l1, l2), atol=1e-5)


def test_metrics_against_numpy(frame):
    y, p = [1.0, 2.0, 4.0, 0.0], [1.5, 2.0, 3.0, 1.0]
    row = metrics.regression_metrics(frame({"y": y, "p": p}, "y double, p double"), "y", "p").first()
    e = np.array(y) - p
    assert row["mse"] == pytest.approx((e**2).mean()) and row["mape"] == pytest.approx(25.0)
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((np.array(y) - np.mean(y)) ** 2).sum())


def test_binary_and_weighted_scores(frame):
    df = frame({"y": [1, 1, 1, 0, 0], "p": [1, 0, 1, 1, 0]}, "y int, p int")
    row = metrics.classification_metrics(df, "y", "p", binary=True).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == pytest.approx((0.6, 2 / 3, 2 / 3))
    row = metrics.classification_metrics(df, "y", "p").first()
    assert row["precision"] == pytest.approx((2 / 3 * 3 + 0.5 * 2) / 5)


def test_auc_is_the_rank_statistic(spark):
    rng = np.random.default_rng(13)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 25, 300) / 10
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s})).repartition(5)
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert metrics.auc(df, "y", "s").first()["auc"] == pytest.approx(wins)


def test_best_model_keeps_the_first_on_a_tie(spark):
    rows = [("a", 0, "r2", 0.5), ("b", 1, "r2", 0.7), ("c", 2, "r2", 0.7)]
    df = spark.createDataFrame(rows, "model string, model_position int, metric string, value double")
    assert modeling.best_model(df, "r2").first()["model"] == "b"


@pytest.mark.parametrize("inertia, k", [([100, 99, 50, 49, 48], 3), ([100, 50, 25, 12], 2), ([5, 5, 5], 2)])
def test_k_by_ratio(spark, inertia, k):
    df = spark.createDataFrame([(i + 2, float(v)) for i, v in enumerate(inertia)], "k int, inertia double")
    drops = [(inertia[i - 1] - inertia[i], inertia[i] - inertia[i + 1]) for i in range(1, len(inertia) - 1)]
    want = next((i + 3 for i, (a, b) in enumerate(drops) if b and a / b < 0.3), 2)
    assert cluster.k_by_ratio(df).first()["k"] == want == k


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a, b = (modeling.hash_split(df.repartition(n), ["id"]).where("part = 'test'") for n in (2, 9))
    assert a.exceptAll(b).isEmpty() and 850 < a.count() < 1150


def test_status_rows(spark, frame):
    small = frame({"x": [1.0]}, "x double")
    assert modeling.modeling_status(small, "x", ["x"]).first()["status"] == "insufficient_data"
    big = spark.range(30)
    assert modeling.modeling_status(big, "id", []).first()["status"] == "no_numeric_data"
    assert modeling.modeling_status(big, "zz", ["id"]).first()["status"] == "invalid_target"


def test_compare_end_to_end(spark):
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame({"id": range(300), "x": rng.normal(size=300), "c": rng.choice(["u", "v"], 300)})
    pdf["y"] = 3 * pdf["x"] + (pdf["c"] == "u") + rng.normal(size=300) * 0.01
    prepared = modeling.prepare(spark.createDataFrame(pdf), "y", ["x", "y"], ["c"], keep=["id"])
    assert prepared.names == ["x", "c_u", "c_v"]
    compared = modeling.compare(prepared, ["id"], "regression", ["ridge", "lasso"])
    assert modeling.best_model(compared.metrics, "r2").first()["model"] == "ridge"
    top = modeling.importance_table(spark, compared.models, prepared.names).where("rank = 1").collect()
    assert {r["feature"] for r in top} == {"x"}


# ---------------------------------------------------------------- density clustering


def brute_force(points, eps, least):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= least
    label, current = np.full(len(points), -1), 0
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = current
                    stack += list(np.flatnonzero(d[j] & core & (label < 0)))
            current += 1
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        label[i] = near.min() if len(near) else -1
    return label, core


@pytest.mark.parametrize("dims, direct", [(1, 4096), (2, 4096), (2, 1), (3, 4), (5, 4096)])
def test_dbscan_equals_brute_force(spark, monkeypatch, dims, direct):
    monkeypatch.setattr(density, "_DIRECT_PAIRS", direct)
    monkeypatch.setattr(density, "_POINTS_PER_SALT", 10)
    rng = np.random.default_rng(dims)
    blobs = [rng.normal(c, 0.25, (50, dims)) for c in (0, 1.6, 4)] + [rng.uniform(-2, 6, (30, dims))]
    points = np.vstack([*blobs, np.full((70, dims), 2.0)]).round(3)  # many copies of one point
    pdf = pd.DataFrame(points, columns=[f"x{i}" for i in range(dims)]).assign(id=range(len(points)))
    sdf = spark.createDataFrame(pdf).repartition(3)
    got = density.dbscan(sdf, "id", [f"x{i}" for i in range(dims)], 0.5, 5).toPandas().sort_values("id")
    label, core = brute_force(points, 0.5, 5)
    assert (got["is_core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy() == label).all()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.range(42).withColumnRenamed("id", "node")
    labels = {r["node"]: r["label"] for r in density.connected_components(nodes, edges).collect()}
    assert set(labels.values()) == {0, 41} and labels[40] == 0


def test_nearest_centre(spark, frame):
    centres = frame({"cluster": [0, 1], "centre": [[0.0, 0.0], [10.0, 0.0]]}, "cluster int, centre array<double>")
    df = frame({"x": [1.0, 9.0, 5.0, None], "y": [0.0, 0.0, 0.0, 1.0]}, "x double, y double")
    got = cluster.nearest_centre(df, ["x", "y"], centres).orderBy("x").collect()
    assert [(r["x"], r["cluster"], r["distance2"]) for r in got] == [(1, 0, 1), (5, 0, 25), (9, 1, 1)]


@pytest.fixture(scope="module")
def steps(spark):
    """A step function of x that ignores the noise column, as numbers and as two or three classes."""
    rng = np.random.default_rng(19)
    pdf = pd.DataFrame({"id": range(240), "x": rng.uniform(0, 3, 240), "noise": rng.normal(size=240)})
    pdf["y"] = np.floor(pdf["x"]) * 10
    pdf["two"] = np.where(pdf["x"] > 1.5, "hi", "lo")
    pdf["three"] = np.array(["a", "b", "c"])[np.floor(pdf["x"]).astype(int)]
    return spark.createDataFrame(pdf)


def test_tree_regressors_find_a_step_function(steps):
    prepared = modeling.prepare(steps, "y", ["x", "noise", "y"], keep=["id"])
    names = ["random_forest", "gradient_boosting", "boosted_depth6", "boosted_leaves31"]
    models = {n: m for n, m in modeling.regression_models(prepared.rows).items() if n in names}
    for name, estimator in models.items():
        small = estimator.copy({estimator.numTrees if name == "random_forest" else estimator.maxIter: 5})
        model = small.fit(prepared.rows)
        score = metrics.regression_metrics(model.transform(prepared.rows), "label", "prediction").first()["r2"]
        assert score > 0.9, name
        assert model.featureImportances[0] > 0.8


@pytest.mark.parametrize("target, classes", [("two", 2), ("three", 3)])
def test_classifiers_separate_classes(steps, target, classes):
    prepared = modeling.prepare(steps, target, ["x", "noise"], keep=["id"], scale=True, classification=True)
    assert prepared.classes == sorted({r[target] for r in steps.select(target).collect()})
    for name, estimator in modeling.classification_models(prepared.rows, classes).items():
        if name in ("gradient_boosting", "boosted_depth6", "boosted_leaves31"):
            if classes > 2:
                continue  # the same learner, one against the rest
            estimator = estimator.copy({estimator.maxIter: 3, estimator.maxDepth: 3})
        if name == "random_forest":
            estimator = estimator.copy({estimator.numTrees: 10})
        labelled = estimator.fit(prepared.rows).transform(prepared.rows)
        accuracy = metrics.classification_metrics(labelled, "label", "prediction").first()["accuracy"]
        # Lines against the rest can't single out a class that lies between two others.
        assert accuracy > (0.6 if name == "linear_svm" and classes > 2 else 0.9), name


def test_logistic_matches_newton_steps(steps):
    prepared = modeling.prepare(steps, "two", ["x", "noise"], classification=True)
    model = modeling.classification_models(prepared.rows, 2)["logistic"].fit(prepared.rows)
    rows = prepared.rows.collect()
    x = np.array([[1.0, *r["features"]] for r in rows])
    y = np.array([r["label"] for r in rows])
    w, penalty = np.zeros(3), np.diag([0, 1.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
    np.testing.assert_allclose([model.intercept, *model.coefficients], w, rtol=1e-3, atol=1e-3)


def test_cross_validation_is_the_mean_over_hash_folds(steps):
    prepared = modeling.prepare(steps, "y", ["x", "noise", "y"], keep=["id"])
    line = LinearRegression(regParam=0.0, solver="normal")
    row = modeling.cross_validation(prepared, line, ["id"], "regression", 3).first()
    fold = F.pmod(F.xxhash64("id"), F.lit(3))
    pdf = prepared.rows.select(fold.alias("fold"), vector_to_array("features").alias("f"), "label").toPandas()
    scores = []
    for k in range(3):
        train, test = pdf[pdf.fold != k], pdf[pdf.fold == k]
        design = lambda part: np.column_stack([np.ones(len(part)), np.stack(part["f"])])
        b = np.linalg.lstsq(design(train), train["label"], rcond=None)[0]
        e = test["label"] - design(test) @ b
        scores.append(1 - (e**2).sum() / ((test["label"] - test["label"].mean()) ** 2).sum())
    assert row["metric"] == "r2" and row["mean"] == pytest.approx(np.mean(scores), abs=1e-6)


def test_both_importances_rank_the_cause_first(steps):
    prepared = modeling.prepare(steps.where("id < 80"), "y", ["x", "noise", "y"])
    table = modeling.two_method_importance(prepared, "regression").toPandas()
    assert set(table["method"]) == {"random_forest", "boosting"}
    assert table[table["rank"] == 1]["feature"].tolist() == ["x", "x"]
    np.testing.assert_allclose(table.groupby("method")["score"].sum(), 1.0)


def test_kmeans_finds_separate_blobs(spark):
    rng = np.random.default_rng(29)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    points = np.concatenate([c + rng.normal(0, 0.3, (40, 2)) for c in centres])
    frame = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"]).assign(id=range(120)))
    vectors = cluster.scaled_vectors(frame, ["a", "b"], keep=["id"])
    models = {}
    sweep = cluster.kmeans_sweep(vectors, largest=5, models=models)
    assert [r["k"] for r in sweep.orderBy("k").collect()] == [2, 3, 4, 5]
    assert cluster.k_by_silhouette(sweep).first()["k"] == 3
    assert sorted(models) == [2, 3, 4, 5]
    labelled, summary = cluster.kmeans_clusters(vectors, 3)
    kept = cluster.kmeans_clusters(vectors, 3, models[3])[1]
    assert kept.orderBy("cluster").collect() == summary.orderBy("cluster").collect()
    found = labelled.toPandas().sort_values("id")
    groups = found["cluster"].to_numpy().reshape(3, 40)
    assert all(len(set(g)) == 1 for g in groups) and len(set(groups[:, 0])) == 3
    scaled = (points - points.mean(0)) / points.std(0)
    inertia = sum(((part - part.mean(0)) ** 2).sum() for part in scaled.reshape(3, 40, 2))
    rows = summary.collect()
    assert [r["size"] for r in rows] == [40] * 3 and rows[0]["inertia"] == pytest.approx(inertia)


def test_principal_components_match_the_decomposition(spark):
    rng = np.random.default_rng(31)
    data = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 3))
    frame = spark.createDataFrame(pd.DataFrame(data, columns=list("abc")).assign(id=range(80)))
    projected, table = cluster.principal_components(cluster.scaled_vectors(frame, list("abc"), keep=["id"]), 2)
    scaled = (data - data.mean(0)) / data.std(0)
    _, s, v = np.linalg.svd(scaled, full_matrices=False)
    rows = table.orderBy("component").collect()
    np.testing.assert_allclose([r["explained_variance_ratio"] for r in rows], (s**2 / (s**2).sum())[:2])
    got = projected.toPandas().sort_values("id")
    for i in range(2):
        np.testing.assert_allclose(np.abs(got[f"pc{i + 1}"]), np.abs(scaled @ v[i]), atol=1e-8)


def test_part_count_is_bounded_both_ways():
    assert [parts.part_count(n, 12) for n in (0, 1, 20_000, 20_001, 120_000, 1_200_000, 3_000_000)] == [1, 1, 1, 2, 6, 12, 12]
    assert [parts.part_count(n, 12) for n in (3_000_001, 7_200_000, 36_000_000)] == [24, 36, 144]


@pytest.mark.parametrize("work", ["compare", "two_methods", "folds", "k_means", "boosting"])
def test_rows_of_one_partition_are_dealt_out_before_models_pass_over_them(spark, monkeypatch, work):
    seen = []

    class Stop(Exception):
        pass

    def record(df):
        seen.append([r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()])
        raise Stop

    for module in (modeling, boosting, cluster):
        monkeypatch.setattr(module, "materialize", record)
    table = spark.range(0, 100_000, 1, 1).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    prepared = modeling.prepare(table, "y", ["x", "y"], keep=["id"])
    with pytest.raises(Stop):
        if work == "compare":
            modeling.compare(prepared, ["id"], "regression", ["linear"])
        elif work == "two_methods":
            modeling.two_method_importance(prepared, "regression")
        elif work == "folds":
            modeling.cross_validation(prepared, None, ["id"], "regression")
        elif work == "k_means":
            cluster.scaled_vectors(table, ["x", "y"])
        else:
            boosting.Boosting(rounds=1).fit(prepared.rows)
    assert sum(seen[0]) == 100_000 and len(seen[0]) == 5 and max(seen[0]) < 25_000


def test_text_features_are_taken_once(spark):
    """Preparing passes over the rows several times, which must not pass over the texts again."""
    rows = models_catalog._quality_prepared(spark, "/root/testdata/sf0.001").rows
    assert rows.count() > 0 and "regexp" not in rows._jdf.queryExecution().toString().lower()
