from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import forecast, timeseries as ts

START = datetime(2024, 1, 1)


def stamps(gap: timedelta, n: int = 5):
    return [START + gap * i for i in range(n)]


@pytest.mark.parametrize(
    "gap, code",
    [
        (timedelta(minutes=30), "H"), (timedelta(hours=1), "H"), (timedelta(hours=2), "6H"), (timedelta(hours=6), "6H"),
        (timedelta(hours=7), "D"), (timedelta(days=1), "D"), (timedelta(days=2), "W"), (timedelta(days=7, hours=23), "W"),
        (timedelta(days=8), "2W"), (timedelta(days=16), "M"), (timedelta(days=34), "M"), (timedelta(days=35), "Q"),
        (timedelta(days=100), "A"),
    ],
)
def test_frequency_code(frame, gap, code):
    df = frame({"t": stamps(gap) * 2}, "t timestamp_ntz")
    assert ts.frequency_code(df, "t").first()["frequency"] == code


@pytest.mark.parametrize(
    "days, label",
    [(1, "Daily"), (7, "Weekly"), (30, "Monthly"), (91, "Quarterly"), (365, "Yearly"), (4, "Approximately every 4 days")],
)
def test_frequency_label(frame, days, label):
    df = frame({"t": stamps(timedelta(days=days))}, "t timestamp_ntz")
    assert ts.frequency_label(df, "t").first()["frequency"] == label


def test_one_date_has_no_frequency(frame):
    df = frame({"t": [START]}, "t timestamp_ntz")
    assert ts.frequency_code(df, "t").first()["frequency"] is None
    assert ts.frequency_label(df, "t").first()["frequency"] == "Insufficient data points"


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"t": stamps(timedelta(hours=1), 200), "id": range(200), "v": rng.normal(10, 2, 200).round(3)})
    return spark.createDataFrame(pdf).repartition(6), pdf


def test_moving_averages(noisy):
    sdf, pdf = noisy
    got = ts.moving_averages(sdf, "t", "v", tie=["id"]).toPandas().sort_values("position")
    for w in ts.MOVING_WINDOWS:
        np.testing.assert_allclose(got[f"ma_{w}"], pdf["v"].rolling(w).mean(), atol=1e-9)
    short = ts.moving_averages(sdf.where("id < 9"), "t", "v").toPandas()
    assert len(short) == 9 and short[[f"ma_{w}" for w in ts.MOVING_WINDOWS]].isna().all(axis=None)


def test_smoothing_is_a_moving_line(noisy):
    sdf, pdf = noisy
    got = ts.smoothed_trend(sdf, "t", "v", tie=["id"]).toPandas().sort_values("position")["trend"].to_numpy()
    y, x = pdf["v"].to_numpy(), np.arange(11)
    np.testing.assert_allclose(got[:5], np.polyval(np.polyfit(x, y[:11], 1), x)[:5])
    np.testing.assert_allclose(got[-5:], np.polyval(np.polyfit(x, y[-11:], 1), x)[-5:])
    assert got[50] == pytest.approx(y[45:56].mean())


def test_autocorrelation(noisy):
    sdf, pdf = noisy
    got = ts.autocorrelation(sdf, "t", "v", tie=["id"]).toPandas().sort_values("lag")["acf"].to_numpy()
    d = pdf["v"].to_numpy() - pdf["v"].mean()
    np.testing.assert_allclose(got, [1] + [d[k:] @ d[:-k] / (d @ d) for k in range(1, 11)])
    pacf = forecast.partial_autocorrelation(sdf, "t", "v", tie=["id"]).toPandas().sort_values("lag")["pacf"].to_numpy()
    r = np.array([(d[k:] @ d[: len(d) - k]) / (200 - k) for k in range(3)])
    second = np.linalg.solve([[r[0], r[1]], [r[1], r[0]]], r[1:3])[1]
    assert pacf[0] == 1 and pacf[1] == pytest.approx(r[1] / r[0]) and pacf[2] == pytest.approx(second)


def test_change_metrics(noisy):
    sdf, pdf = noisy
    row = ts.change_metrics(sdf, "t", "v", tie=["id"]).first()
    pct = pdf["v"].pct_change() * 100
    assert row["start_value"] == pdf["v"].iloc[0] and row["end_value"] == pdf["v"].iloc[-1]
    assert row["avg_change"] == pytest.approx(pdf["v"].diff().mean())
    assert row["avg_pct_change"] == pytest.approx(pct.mean()) and row["volatility"] == pytest.approx(pct.std())


def test_zero_start_has_no_total_percentage(frame):
    df = frame({"t": stamps(timedelta(days=1), 3), "v": [0.0, 1.0, 2.0]}, "t timestamp_ntz, v double")
    assert ts.change_metrics(df, "t", "v").first()["pct_total_change"] is None


def test_decomposition_recovers_a_season(spark):
    season = np.array([0, 1, 4, -2, -3, 1, -1.0])
    y = 0.5 * np.arange(70) + np.tile(season, 10)
    pdf = pd.DataFrame({"ts": [d.date() for d in stamps(timedelta(days=1), 70)], "value": y})
    regular = ts.regularize(spark.createDataFrame(pdf, "ts date, value double"))
    got = ts.decompose(regular, 7).toPandas().sort_values("idx")
    np.testing.assert_allclose(got["seasonal"], np.tile(season - season.mean(), 10), atol=1e-9)
    inner = got["trend"].notna()
    total = got["trend"] + got["seasonal"] + got["residual"]
    np.testing.assert_allclose(total[inner], got["value"][inner])
    assert inner.sum() == 64
    short = ts.decompose(regular.where("idx < 10"), 7).select("status").distinct().collect()
    assert [r["status"] for r in short] == ["not enough points"]


def test_regularize_gaps(frame):
    days = [START.date() + timedelta(days=i) for i in (0, 1, 4)]
    df = frame({"ts": days, "value": [0.0, 2.0, 8.0]}, "ts date, value double")
    assert ts.regularize(df).toPandas().sort_values("idx")["value"].tolist() == [0, 2, 4, 6, 8]


@pytest.mark.parametrize("code, alias", [("H", "h"), ("6H", "6h"), ("D", "D"), ("W", "W"), ("2W", "2W"), ("M", "ME"), ("Q", "QE"), ("A", "YE")])
@pytest.mark.parametrize("last", [datetime(2023, 12, 31), datetime(2024, 1, 30, 5)])
def test_future_dates(frame, code, alias, last):
    got = forecast.future_dates(frame({"t": [last]}, "t timestamp_ntz"), "t", code, 6).orderBy("step").collect()
    periods = pd.date_range(last, periods=20, freq=alias)
    want = [p for p in periods if p > pd.Timestamp(last)][:6]
    assert [r["ts"].date() for r in got] == [p.date() for p in want]


@pytest.mark.parametrize("n, quality", [(9, "Poor"), (10, "Fair"), (29, "Fair"), (30, "Good"), (99, "Good"), (100, "Excellent")])
def test_readiness(frame, n, quality):
    df = frame({"t": stamps(timedelta(days=1), n)}, "t timestamp_ntz")
    assert ts.forecast_readiness(df, "t").first()["quality"] == quality


def test_limitations(frame):
    df = frame({"t": [START, START + timedelta(days=40)], "v": [1.0, 2.0]}, "t timestamp_ntz, v double")
    assert len(ts.forecast_limitations(df, "t", "v").first()["limitations"]) == 3
    df = frame({"t": stamps(timedelta(days=1), 400), "v": [1.0] * 400}, "t timestamp_ntz, v double")
    assert ts.forecast_limitations(df, "t", "v").first()["limitations"] == ["Standard forecasting uncertainty applies"]


def test_calendar_needs_a_week(frame):
    df = frame({"t": stamps(timedelta(days=1), 6)}, "t timestamp_ntz")
    assert ts.calendar_grid(df, "t").count() == 0


def test_arima_recovers_parameters():
    rng = np.random.default_rng(7)
    e = rng.normal(size=4000)
    w = np.zeros(4000)
    for i in range(1, 4000):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
    phi, theta, sigma2, _ = forecast.arima_parameters(np.cumsum(w))
    assert phi == pytest.approx(0.6, abs=0.06) and theta == pytest.approx(0.3, abs=0.06)
    assert sigma2 == pytest.approx(1, abs=0.08)


def test_arima_per_series(spark, noisy):
    pdf = noisy[1].rename(columns={"t": "ts", "v": "value"})
    both = spark.createDataFrame(pd.concat([pdf.assign(k="a"), pdf.head(8).assign(k="b")]))
    got = forecast.arima_forecast(both, ["k"]).toPandas()
    short = got[got["k"] == "b"]
    assert len(short) == 1 and short[["step", "forecast", "phi"]].isna().all(axis=None)
    long = got[got["k"] == "a"]
    assert len(got) == 41 and len(long) == 40 and long["actual"].notna().all()


def test_holt_winters_on_an_exact_pattern(spark):
    season = np.array([5, -2, 0, 1, 3, -4, 2, -1, 0, -3, 1, -2.0])
    y = 100 + 2.0 * np.arange(60) + np.tile(season, 5)
    pdf = pd.DataFrame({"ts": stamps(timedelta(days=30), 60), "value": y})
    got = forecast.holt_winters_forecast(spark.createDataFrame(pdf)).toPandas().sort_values("step")
    want = 100 + 2.0 * np.arange(60, 66) + season[:6]
    np.testing.assert_allclose(got["forecast"], want, atol=3)
    short = forecast.holt_winters_forecast(spark.createDataFrame(pdf.head(20))).collect()
    assert [tuple(r) for r in short] == [(None,) * 6]


def test_trend_season_forecast_per_key(spark):
    months = pd.date_range("2020-01-01", periods=48, freq="MS")
    years = np.asarray((months - months[0]).days) / 365.25
    curves = {"a": 5 + 3 * years + 2 * np.sin(2 * np.pi * years), "b": 100 - years + np.cos(4 * np.pi * years)}
    rows = [(k, m.date(), float(v)) for k, c in curves.items() for m, v in zip(months, c)] + [("short", months[0].date(), 1.0)]
    got = forecast.trend_season_forecast(spark.createDataFrame(rows, "k string, ts date, value double"), ["k"]).toPandas()
    ahead = pd.date_range(months[-1], periods=7, freq="MS")[1:]
    t = np.asarray((ahead - months[0]).days) / 365.25
    want = {"a": 5 + 3 * t + 2 * np.sin(2 * np.pi * t), "b": 100 - t + np.cos(4 * np.pi * t)}
    for k, values in want.items():
        part = got[got.k == k].sort_values("step")
        np.testing.assert_allclose(part.forecast, values, atol=1e-6)
        assert list(part.ts) == [a.date() for a in ahead]
    assert got[got.k == "short"].forecast.isna().all() and len(got) == 18
