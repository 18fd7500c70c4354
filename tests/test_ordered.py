import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ordered
from plumbline.functions.quantiles import grouped_quantiles, quantile_aggregates


@pytest.fixture(scope="module")
def rows(spark):
    """One key with a third of all rows, repeated order values, some NULLs."""
    rng = np.random.default_rng(1)
    n = 900
    pdf = pd.DataFrame(
        {
            "k": np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 30, n)),
            "t": rng.integers(0, 40, n),
            "id": np.arange(n),
            "v": np.round(rng.normal(size=n), 3),
        }
    )
    sdf = spark.createDataFrame(pdf).withColumn("g", F.when(F.pmod(F.col("id") * 7, F.lit(5)) == 0, F.col("v")))
    return sdf.repartition(7).cache(), pdf.assign(g=np.where((pdf["id"] * 7) % 5 == 0, pdf["v"], np.nan))


@pytest.mark.parametrize("blocks", [1, 5])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_position_is_dense_and_ordered(rows, keys, blocks):
    sdf, pdf = rows
    got = ordered.with_position(sdf, ["t", "id"], keys, blocks).toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["t", "id"])
    position = want.groupby("k").cumcount() if keys else pd.Series(range(len(want)), index=want.index)
    assert (got[ordered.POSITION] == position.sort_index().values).all()
    size = pdf.groupby("k")["id"].transform("size") if keys else len(pdf)
    assert (got[ordered.SERIES_SIZE] == size).all()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_totals(rows, keys):
    sdf, pdf = rows
    got = ordered.running_totals(sdf, {"s": "v"}, ["t", "id"], keys, 5).toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["t", "id"])
    total = want.groupby("k")["v"].cumsum() if keys else want["v"].cumsum()
    np.testing.assert_allclose(got["s"], total.sort_index(), atol=1e-9)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_fill_forward_backward(rows, keys):
    sdf, pdf = rows
    got = ordered.fill_forward_backward(sdf, ["g"], ["t", "id"], keys, 5).toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["t", "id"])
    filled = want.groupby("k")["g"].ffill() if keys else want["g"].ffill()
    filled = filled.groupby(want["k"]).bfill() if keys else filled.bfill()
    np.testing.assert_allclose(got["g"], filled.sort_index())


def test_neighbour_windows_cross_chunks(rows):
    sdf, pdf = rows
    placed = ordered.with_position(sdf, ["t", "id"], ["k"], 5)
    mean = lambda w: {"m": F.avg("v").over(w.rowsBetween(-4, 2))}
    chunked = ordered.over_neighbours(placed, mean, before=4, after=2, keys=["k"], chunk_rows=8)
    whole = ordered.over_neighbours(placed, mean, before=4, after=2, keys=["k"])
    a, b = (x.toPandas().set_index("id").sort_index() for x in (chunked, whole))
    assert len(a) == len(pdf)
    np.testing.assert_allclose(a["m"], b["m"])


def test_quantiles_by_narrowing_match_numpy(rows, spark):
    sdf, pdf = rows
    hot = np.concatenate([np.full(400, 2.5), np.random.default_rng(2).lognormal(0, 3, 700), [-1e12, 1e12]])
    heavy = spark.createDataFrame(pd.DataFrame({"x": hot}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    for frame, column, values in ((sdf, "v", pdf["v"]), (sdf, "g", pdf["g"].dropna()), (heavy, "x", hot)):
        expected = np.quantile(values, probs)
        row = frame.agg(quantile_aggregates(frame, [column], probs)[column].alias("a")).first()
        np.testing.assert_allclose(row["a"], expected, rtol=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert empty.select(quantile_aggregates(empty, ["x"], [0.5])["x"][0].alias("m")).first()["m"] is None


def test_grouped_quantiles(rows):
    sdf, pdf = rows
    got = grouped_quantiles(sdf, ["k"], "v", [0.25, 0.5]).toPandas().set_index("k")["quantiles"]
    want = pdf.groupby("k")["v"].quantile([0.25, 0.5]).unstack()
    for k, values in got.items():
        np.testing.assert_allclose(values, want.loc[k], atol=1e-12)


def test_quantiles_of_one_frequent_value_stay_spread(spark):
    values = np.concatenate([np.full(1800, 3.0), np.random.default_rng(4).normal(0, 5, 200)])
    frame = spark.createDataFrame(pd.DataFrame({"k": 1, "x": values})).repartition(8)
    probs = [0.01, 0.05, 0.5, 0.97]
    got = grouped_quantiles(frame, ["k"], "x", probs).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(values, probs), rtol=1e-12)
    counted = frame.groupBy("k", "x").count()
    sizes = [r["count"] for r in ordered.ordered_blocks(counted, ["x"], ["k"], 8).groupBy("_block").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
