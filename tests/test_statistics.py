import numpy as np
import pandas as pd
import pytest

from plumbline.operators import associate, business, describe, metrics


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.gamma(2, 3, 400).round(2), "y": rng.normal(size=400).round(1)})
    pdf["z"] = pdf["x"] * 2 - pdf["y"]
    pdf.loc[5:20, "y"] = np.nan
    rows = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "x double, y double, z double").repartition(5), pdf


def test_moments_match_pandas(sample):
    sdf, pdf = sample
    got = describe.numeric_describe(sdf, ["x", "y"], extended=True).toPandas().set_index("column")
    for c in ("x", "y"):
        want = {
            "count": pdf[c].count(), "mean": pdf[c].mean(), "std": pdf[c].std(), "median": pdf[c].median(),
            "q1": pdf[c].quantile(0.25), "skewness": pdf[c].skew(), "kurtosis": pdf[c].kurt(),
        }
        for metric, value in want.items():
            assert got.loc[c, metric] == pytest.approx(value, rel=1e-9), (c, metric)


def test_constant_and_tiny_columns(frame):
    row = describe.numeric_describe(frame({"x": [2.0] * 5}, "x double"), ["x"], True).first()
    assert row["skewness"] == 0 and row["kurtosis"] == 0
    row = describe.numeric_describe(frame({"x": [2.0, 3.0]}, "x double"), ["x"], True).first()
    assert row["skewness"] is None and row["kurtosis"] is None
    assert describe.z_outliers(frame({"x": [2.0] * 5}, "x double"), ["x"]).first()["outliers"] == 0


def test_histogram_matches_numpy(sample):
    sdf, pdf = sample
    got = describe.histogram(sdf, "x").toPandas().sort_values("bin")
    counts, edges = np.histogram(pdf["x"], bins="auto")
    assert got["n"].tolist() == counts.tolist()
    np.testing.assert_allclose(got["lower"], edges[:-1])
    assert describe.histogram(sdf.where("x = -1").union(sdf.limit(1)), "x").collect()[0]["n"] == 1


def test_density_integrates_to_one(sample):
    got = describe.density_curve(sample[0], "x").toPandas().sort_values("x")
    area = np.trapezoid(got["density"], got["x"])
    assert 0.85 < area < 1.01  # the grid ends at the extremes


@pytest.mark.parametrize("longest", [60.0, 1e4, 1e7])
def test_density_of_a_long_tail(spark, longest):
    values = np.append(np.random.default_rng(4).gamma(2, 3, 3000), [longest, longest / 2])
    sdf = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    got = describe.density_curve(sdf, "x", 400).toPandas().sort_values("grid")
    width = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 400)
    want = np.exp(-(((grid[:, None] - values) / width) ** 2) / 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))
    assert got["grid"].tolist() == list(range(400))
    np.testing.assert_allclose(got["x"], grid, rtol=1e-9)
    np.testing.assert_allclose(got["density"], want, rtol=2e-3, atol=1e-3 * want.max())


def test_density_without_values_or_spread(frame):
    assert describe.density_curve(frame({"x": [None]}, "x double"), "x").count() == 0
    assert {r["density"] for r in describe.density_curve(frame({"x": [2.0] * 3}, "x double"), "x").collect()} == {None}


def test_correlations_match_pandas(sample):
    sdf, pdf = sample
    got = associate.pearson_pairs(sdf, ["x", "y", "z"], 9).toPandas().set_index(["feature1", "feature2"])["correlation"]
    want = pdf.corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-8)
    row = associate.spearman(sdf, "x", "y", 9).first()
    both = pdf[["x", "y"]].dropna().rank()
    assert row["spearman"] == pytest.approx(both["x"].corr(both["y"]), abs=1e-8)


def test_shapiro_wilk_against_direct_formula(sample):
    sdf, pdf = sample
    from statistics import NormalDist

    x = np.sort(pdf["x"].to_numpy())
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / np.sqrt(n)
    c = m / np.sqrt(m @ m)
    a = np.zeros(n)
    a[-1] = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
    a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / np.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    row = associate.shapiro_wilk(sdf, "x").first()
    assert row["statistic"] == pytest.approx(w, abs=1e-7)
    assert not row["is_normal"] and associate.shapiro_wilk(sdf, "y").first()["statistic"] > 0.98


@pytest.mark.parametrize(
    "values, w, p",
    [
        ([1, 2, 4], 0.96429, 0.6369),
        ([1, 2, 3, 4, 5], 0.98676, 0.9672),
        ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704),
        ([1, 1, 1, 1], None, None),
        ([1, 2], None, None),
        ([], None, None),
    ],
)
def test_shapiro_wilk_of_few_values(frame, values, w, p):
    row = associate.shapiro_wilk(frame({"x": [float(v) for v in values]}, "x double"), "x").first()
    assert row["n"] == len(values)
    if w is None:
        assert row["statistic"] is None and row["p_value"] is None and row["is_normal"] is None
    else:
        assert row["statistic"] == pytest.approx(w, abs=2e-5) and row["p_value"] == pytest.approx(p, rel=2e-3)


def test_dense_table_and_confusion_grid_without_collected_lists(frame):
    df = frame({"a": ["x", "x", "y"], "b": ["p", "q", "p"], "k": [1, 1, 2]}, "a string, b string, k int")
    dense = {(r["row_value"], r["col_value"]): r["n"] for r in associate.contingency(df, "a", "b", dense=True).collect()}
    assert dense == {("x", "p"): 1, ("x", "q"): 1, ("y", "p"): 1, ("y", "q"): 0}
    grid = metrics.confusion_matrix(df, "a", "b", ["k"])
    assert grid.count() == 2 * 16 and grid.agg({"n": "sum"}).first()[0] == 3


def test_jarque_bera_skips_tiny(frame):
    assert associate.jarque_bera(frame({"x": [1.0, 2.0, 3.0]}, "x double"), ["x"]).count() == 0


def test_mutual_information_of_copy_is_entropy(frame):
    df = frame({"a": ["u", "v"] * 50, "b": ["u", "v"] * 50, "c": ["k"] * 100}, "a string, b string, c string")
    got = {r["feature"]: r["mutual_info"] for r in associate.mutual_information(df, ["b", "c"], "a").collect()}
    assert got["b"] == pytest.approx(np.log(2)) and got["c"] == pytest.approx(0)


def test_shares_sum_to_hundred(frame):
    df = frame({"a": ["p", "p", "q", None], "b": ["x", "y", "x", "x"]}, "a string, b string")
    shares = associate.row_shares(df, "a", "b", digits=10).toPandas().groupby("row_value")["share"].sum()
    np.testing.assert_allclose(shares, 100)
    assert associate.contingency(df, "a", "b", dense=True).count() == 4
    assert {r["value"]: r["share_pct"] for r in business.group_share(df, "a").collect()} == {"p": 50, "q": 25}


def test_priorities(spark):
    texts = ["Address missing values now", "Normalize it", "Encode variables", "Other"]
    got = business.prioritize(spark.createDataFrame([(t,) for t in texts], "recommendation string")).collect()
    assert [(r["recommendation"], r["priority_score"]) for r in got] == [
        ("Address missing values now", 8), ("Normalize it", 7), ("Encode variables", 5), ("Other", 5)
    ]


def test_demand_rounds_down(frame):
    row = business.product_demand(frame({"p": ["a"] * 19}, "p string"), "p").first()
    assert row["projected_demand"] == 20 and row["daily_demand"] == pytest.approx(0.6333)
