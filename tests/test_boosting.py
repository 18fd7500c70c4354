"""Second-order boosting against a plain numpy version."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from plumbline.operators import boosting, modeling


def table_of(spark, x, y):
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ["id", *names, "label"]).repartition(3)
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)


def plain_tree(bins, g, h, p):
    """Best-first growth over lists of rows; returns the values of the rows and the number of leaves."""

    def best(rows):
        found = (-1.0,)
        G, H = g[rows].sum(), h[rows].sum()
        for f in range(bins.shape[1]):
            for b in np.unique(bins[rows, f])[:-1]:
                left = rows[bins[rows, f] <= b]
                gl, hl = g[left].sum(), h[left].sum()
                if min(hl, H - hl) < p.min_child_weight or min(len(left), len(rows) - len(left)) < p.min_child_rows:
                    continue
                gain = (gl**2 / (hl + p.reg_lambda) + (G - gl) ** 2 / (H - hl + p.reg_lambda) - G**2 / (H + p.reg_lambda)) / 2
                if gain > found[0] + 1e-9:
                    found = (gain, left, rows[bins[rows, f] > b])
        return found

    leaves = [(best(np.arange(len(g))), np.arange(len(g)), 0)]
    while not p.max_leaves or len(leaves) < p.max_leaves:
        able = [x for x in leaves if x[0][0] > 1e-12 and (not p.max_depth or x[2] < p.max_depth)]
        if not able:
            break
        top = max(able, key=lambda x: x[0][0])
        leaves = [x for x in leaves if x is not top] + [(best(r), r, top[2] + 1) for r in top[0][1:]]
    out = np.empty(len(g))
    for _, rows, _ in leaves:
        out[rows] = -p.learning_rate * g[rows].sum() / (h[rows].sum() + p.reg_lambda)
    return out, len(leaves)


_LEAVES = {"max_depth": 0, "max_leaves": 9, "min_child_rows": 5, "reg_lambda": 0.0, "learning_rate": 0.1}


@pytest.mark.parametrize("objective, classes, growth", [("squared", 0, {"max_depth": 3}), ("logistic", 2, _LEAVES), ("softmax", 3, _LEAVES)])
def test_equals_plain_version(spark, objective, classes, growth):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4)).round(2)
    x[:, 3] = rng.integers(0, 3, 2000)
    signal = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 3] == 1) + rng.normal(size=2000) * 0.3
    y = signal if not classes else np.digitize(signal, [0.0] if classes == 2 else [-0.4, 0.5])
    p = boosting.Boosting(rounds=2, objective=objective, classes=classes, bins=40, **growth)
    rows = table_of(spark, x, y)
    model = p.fit(rows)
    bins = boosting.binned(x, model.cuts)
    scores = np.tile(model.base, (len(y), 1))
    for trees in model.rounds:
        g, h = boosting.derivatives(scores, np.asarray(y, float), objective)
        step = [plain_tree(bins, g[:, k], h[:, k], p) for k in range(scores.shape[1])]
        assert [t.feature.count(-1) for t in trees] == [n for _, n in step]
        scores += np.stack([v for v, _ in step], axis=1)
    np.testing.assert_allclose(model.scores(bins), scores, atol=1e-7)
    got = sorted(model.transform(rows).collect(), key=lambda r: r["id"])
    if classes:
        want = boosting.probabilities(scores)
        np.testing.assert_allclose([r["probability"] for r in got], want, atol=1e-7)
        assert [r["prediction"] for r in got] == want.argmax(axis=1).tolist()
    else:
        np.testing.assert_allclose([r["prediction"] for r in got], scores[:, 0], atol=1e-7)


def test_missing_values_constant_columns_and_few_rows(spark):
    x = np.array([[1.0, np.nan], [1.0, 2.0], [1.0, 3.0], [1.0, np.nan]])
    rows = table_of(spark, x, np.array([0.0, 1.0, 1.0, 0.0]))
    model = boosting.Boosting(rounds=2, reg_lambda=0.0, learning_rate=1.0).fit(rows)
    got = sorted(model.transform(rows).collect(), key=lambda r: r["id"])
    assert [round(r["prediction"], 6) for r in got] == [0, 1, 1, 0]
    assert model.gains == [0.0, 1.0]
    flat = boosting.Boosting(rounds=2).fit(table_of(spark, np.ones((3, 1)), np.ones(3)))
    assert flat.rounds[0][0].feature == [-1] and flat.scores(np.zeros((1, 1), np.uint8))[0, 0] == pytest.approx(1)
    empty = boosting.Boosting(rounds=2).fit(rows.limit(0))
    assert empty.rounds == []


def test_wide_tables_take_further_scans(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    rows = table_of(spark, x, x[:, 0] * x[:, 1])
    p = boosting.Boosting(rounds=1, max_depth=3)
    whole = p.fit(rows)
    monkeypatch.setattr(boosting, "SCAN_CELLS", 1)
    assert p.fit(rows).rounds[0][0].feature == whole.rounds[0][0].feature


def test_comparison_has_rows_of_its_own(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 2))
    rows = table_of(spark, x, (x[:, 0] * x[:, 1] > 0).astype(int))
    prepared = modeling.Prepared(rows.select("id", "features", "label"), ["x0", "x1"], ["0", "1"])
    got = modeling.compare(prepared, ["id"], "classification", ["second_order_depth6"], boosting_rounds=5)
    values = {r["metric"]: r["value"] for r in got.metrics.collect()}
    assert values["accuracy"] > 0.85 and got.predictions.where("score is null").isEmpty()
    ranked = modeling.importance_table(spark, got.models, prepared.names)
    assert ranked.count() == 2
