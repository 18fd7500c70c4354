"""Exact ARIMA likelihood and trends with change points."""

import itertools

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import arima, changepoints, forecast


def autocovariances(ar, ma, n):
    """Of an ARMA process with unit variance, from its first 4,000 shock weights."""
    psi = np.zeros(4000)
    full = np.r_[1.0, ma]
    for k in range(len(psi)):
        psi[k] = (full[k] if k < len(full) else 0) + sum(a * psi[k - i - 1] for i, a in enumerate(ar) if k > i)
    return np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])


@pytest.mark.parametrize("ar, ma", [([0.6], [0.3]), ([-0.5], []), ([], [0.9]), ([0.5, -0.3], [0.4]), ([0.2], [0.5, 0.3])])
def test_likelihood_equals_the_dense_gaussian(ar, ma):
    w = np.random.default_rng(1).normal(size=50).cumsum() * 0.3
    gamma = autocovariances(ar, ma, 50) * 1.7
    cov = gamma[np.abs(np.subtract.outer(np.arange(50), np.arange(50)))]
    dense = -0.5 * (50 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + w @ np.linalg.solve(cov, w))
    assert arima.log_likelihood(w, np.array(ar), np.array(ma), 1.7) == pytest.approx(dense, abs=1e-7)


def simulated(ar, ma, n, seed):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 100), np.zeros(n + 100)
    for t in range(3, n + 100):
        w[t] = e[t] + sum(a * w[t - i - 1] for i, a in enumerate(ar)) + sum(m * e[t - i - 1] for i, m in enumerate(ma))
    return w[100:]


@pytest.mark.parametrize("ar, ma", [([0.6], [0.3]), ([-0.4], [0.7]), ([0.8], [-0.5])])
def test_parameters_within_sampling_error(ar, ma):
    n = 3000
    model = arima.fit(np.cumsum(simulated(ar, ma, n, 7)))
    phi, theta = ar[0], ma[0]
    error = np.sqrt(((1 + phi * theta) / (phi + theta)) ** 2 * np.array([1 - phi**2, 1 - theta**2]) / n)
    assert abs(model.ar[0] - phi) < 3 * error[0] and abs(model.ma[0] - theta) < 3 * error[1]
    assert model.sigma2 == pytest.approx(1, abs=0.1)


def test_no_grid_point_is_likelier():
    for seed in range(3):
        w = simulated([0.3], [0.2], 40, seed)
        model = arima.fit(np.cumsum(np.r_[0, w]))
        grid = np.linspace(-0.95, 0.95, 39)
        best = max(arima.log_likelihood(w, np.array([a]), np.array([b])) for a, b in itertools.product(grid, grid))
        assert model.likelihood >= best - 1e-6


def test_forecasts_follow_the_recursion():
    y = np.cumsum(simulated([0.5], [0.4], 200, 3))
    model = arima.fit(y)
    point, error = model.forecast(4)
    w, e, hat = np.diff(y), 0.0, 0.0
    for value in w:
        e = value - hat
        hat = model.ar[0] * value + model.ma[0] * e
    moves = hat * model.ar[0] ** np.arange(4)
    np.testing.assert_allclose(point, y[-1] + np.cumsum(moves), atol=1e-6)
    psi = np.cumsum(np.r_[1, (model.ar[0] + model.ma[0]) * model.ar[0] ** np.arange(3)])
    np.testing.assert_allclose(error, np.sqrt(model.sigma2 * np.cumsum(psi**2)), rtol=1e-9)


def test_constant_series_stays():
    model = arima.fit(np.full(20, 4.0))
    assert model.sigma2 == 0 and model.forecast(3)[0].tolist() == [4, 4, 4]


def test_methods_agree_on_long_series(spark):
    y = 50 + np.cumsum(simulated([0.6], [0.3], 400, 9))
    pdf = pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=400), "value": y})
    df = spark.createDataFrame(pdf)
    both = [forecast.arima_forecast(df, method=m).toPandas().iloc[0] for m in ("likelihood", "conditional")]
    assert both[0].phi == pytest.approx(both[1].phi, abs=0.05) and both[0].sigma2 == pytest.approx(both[1].sigma2, rel=0.05)
    with pytest.raises(ValueError):
        forecast.arima_forecast(df, method="guess")


# ---------------------------------------------------------------- change points


def broken(months, at, before, after, noise, rng):
    t = np.arange(months)
    return 100 + before * t + (after - before) * np.maximum(0, t - at) + 3 * np.sin(2 * np.pi * t / 12) + rng.normal(size=months) * noise


def test_planted_breaks_are_found(spark):
    rng, rows, breaks = np.random.default_rng(2), [], {}
    dates = pd.date_range("2015-01-01", periods=72, freq="MS")
    for k in range(8):
        breaks[k] = at = 12 + 5 * k
        rows += [(k, d.date(), float(v)) for d, v in zip(dates, broken(72, at, 2.0, -3.0 if k % 2 else 6.0, 0.3, rng))]
    df = spark.createDataFrame(rows, "k int, ts date, value double")
    got = changepoints.change_points(df, ["k"], spec=changepoints.Trend(changes=56)).toPandas()
    for k, at in breaks.items():
        part = got[got.k == k]
        near = part[(pd.to_datetime(part.ts) - dates[at]).abs() <= pd.Timedelta(days=62)]
        assert near.share.sum() > 0.6
        largest = pd.Timestamp(part.loc[part.share.idxmax(), "ts"])
        assert abs((largest - dates[at]).days) <= 31
        assert (near.slope_change.sum() > 0) == (k % 2 == 0)


def test_bounds_cover_about_four_of_five(spark):
    rng, rows, future = np.random.default_rng(3), [], {}
    dates = pd.date_range("2012-01-01", periods=102, freq="MS")
    for k in range(30):
        y = broken(102, 40, 1.0, 2.0, 4.0, rng)
        rows += [(k, d.date(), float(v)) for d, v in zip(dates[:96], y[:96])]
        future[k] = y[96:]
    df = spark.createDataFrame(rows, "k int, ts date, value double")
    got = changepoints.change_point_forecast(df, ["k"]).toPandas().sort_values(["k", "step"])
    actual = np.concatenate([future[k] for k in sorted(future)])
    inside = ((got.lower_bound <= actual) & (actual <= got.upper_bound)).mean()
    assert 0.72 < inside < 0.95 and list(got.ts[:6]) == [d.date() for d in dates[96:]]


@pytest.mark.parametrize("seed", range(20))
def test_penalised_solution_is_optimal(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(60, 8)), rng.normal(size=60)
    if seed % 2:
        x[:, 3:] = np.cumsum(x[:, 3:] * 0.05, axis=1)  # nearly collinear
    xx, xy = x.T @ x, x.T @ y
    l1, l2 = np.r_[np.zeros(2), np.full(6, 0.5 + seed % 7)], np.full(8, 0.1)
    b = changepoints.penalised(xx, xy, l1, l2, np.zeros(8))
    slope = xx @ b - xy + l2 * b
    active = b != 0
    np.testing.assert_allclose((slope + l1 * np.sign(b))[active], 0, atol=1e-6)
    assert (np.abs(slope[~active]) <= l1[~active] + 1e-6).all()


def test_many_rows_a_day_short_and_missing_series(spark):
    days = [d.to_pydatetime() for d in pd.date_range("2021-01-01", periods=200)]
    rows = [("a", d, float(i + j)) for i, d in enumerate(days) for j in (-1, 0, 1)] + [("b", days[0], 1.0), ("b", days[1], None), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, value double")
    got = changepoints.change_point_forecast(df, ["k"]).toPandas().sort_values(["k", "step"])
    a = got[got.k == "a"]
    want = [(pd.Timestamp(d) - pd.Timestamp(days[0])).days for d in a.ts]
    np.testing.assert_allclose(a.forecast, want, rtol=0.03)
    assert got[got.k == "b"].forecast.isna().all() and len(got) == 12
    assert changepoints.change_points(df.where("k = 'b'"), ["k"]).count() == 0
    assert changepoints.change_point_forecast(df.where("k = 'z'")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_solution_is_optimal_on_collinear_candidates(seed):
    rng = np.random.default_rng(seed)
    days = np.sort(rng.choice(2000, 300, replace=False)).astype(float)
    days -= days[0]
    shape = changepoints.FittedTrend(changepoints.Trend(), days[-1], 1.0, np.linspace(0.03, 0.8, 25), np.zeros(0), 0.0, True)
    x = shape.design(days)
    y = np.sin(days / 150) + rng.normal(size=300) * 0.1
    xx, xy = x.T @ x, x.T @ y
    l1 = np.zeros(x.shape[1])
    l1[2:27] = [0.01, 0.1, 0.3, 1.0, 3.0, 10.0][seed]
    b = changepoints.penalised(xx, xy, l1, np.full(len(l1), 1e-4), np.zeros(len(l1)))
    slope = xx @ b - xy + 1e-4 * b
    free, active = l1 == 0, b != 0
    assert np.abs((slope + l1 * np.sign(b))[active | free]).max() < 1e-5
    assert (np.abs(slope[~active]) <= l1[~active] + 1e-5).all()
