"""Forecasts on aggregated series, their errors and the future dates they belong to.

The recursive models run per series inside ``applyInPandas``. They take series that are aggregated to
a calendar grain, whose length is bounded by the calendar; many series spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.ordered import null_safe_join
from plumbline.functions.statistics import safe_divide
from plumbline.operators import arima
from plumbline.operators.timeseries import MIN_POINTS, autocorrelation


def _too_short(rows: pd.DataFrame, names: Sequence[str], schema: T.StructType) -> pd.DataFrame:
    """One row for a series that is too short: its key, and NULL for everything else."""
    return pd.DataFrame({f.name: [rows[f.name].iloc[0] if f.name in names else None] for f in schema.fields})


# ---------------------------------------------------------------- errors and dates


def forecast_errors(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, n, mae, rmse, mape)`` over the rows where both numbers are known."""
    e = F.col(actual) - F.col(predicted)
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(safe_divide(e, F.col(actual)))) * 100).alias("mape"),
    )


def future_dates(df: DataFrame, date: str, frequency: str | Column, steps: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, step, ts)``: the next dates after the last one at a frequency code.

    Hours and days count from the last date. Weeks go to Sundays and month, quarter and year codes to
    the period ends, as calendar frequencies do: a last date inside a week first moves to its Sunday,
    keeping its time of day.
    """
    code = F.lit(frequency) if isinstance(frequency, str) else frequency
    last = df.groupBy(*keys).agg(F.max(date).cast("timestamp").alias("_last"))
    rows = last.where("_last is not null").select(
        *keys, "_last", code.alias("_f"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    )
    s, day = F.col("step"), F.to_date("_last")

    def period_end(months: int, unit: str) -> Column:
        """End of the period ``s`` steps on; a last date inside a period first moves to its end."""
        this_end = F.date_sub(F.add_months(F.trunc(day, unit), months), 1)
        ahead = F.when(day == this_end, s).otherwise(s - 1)
        return F.date_sub(F.add_months(F.trunc(day, unit), months * (ahead + 1)), 1)

    hours = {"H": 1, "6H": 6, "D": 24}
    ts = None
    for name, length in hours.items():
        moved = F.timestamp_micros(F.unix_micros("_last") + s * F.lit(length * 3_600_000_000))
        ts = F.when(F.col("_f") == name, moved) if ts is None else ts.when(F.col("_f") == name, moved)
    to_sunday = (6 - F.weekday(day)).cast("long")
    for name, weeks in (("W", 1), ("2W", 2)):
        days = to_sunday + 7 * weeks * (s - F.when(to_sunday == 0, 0).otherwise(1))
        moved = F.timestamp_micros(F.unix_micros("_last") + days * F.lit(86_400_000_000))
        ts = ts.when(F.col("_f") == name, moved)
    for name, months, unit in (("M", 1, "month"), ("Q", 3, "quarter"), ("A", 12, "year")):
        ts = ts.when(F.col("_f") == name, period_end(months, unit).cast("timestamp"))
    return rows.select(*keys, "step", ts.alias("ts"))


# ---------------------------------------------------------------- partial autocorrelation


def partial_autocorrelation(
    df: DataFrame, date: str, value: str, keys: Sequence[str] = (), tie: Sequence[str] = (), max_lag: int = 10
) -> DataFrame:
    """``(keys, lag, pacf)`` by the Yule-Walker equations with sample-size adjusted covariances.

    Spark computes the covariances; each series then solves at most ``max_lag + 1`` numbers.
    """
    names = list(keys) or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(0))
    lags = autocorrelation(base, date, value, names, tie, max_lag, covariances=True)
    fields = [f for f in lags.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        if rows["points"].iloc[0] < MIN_POINTS["autocorrelation"]:
            return rows[names + ["lag"]].assign(pacf=np.nan)
        r = (rows["covariance_sum"] / (rows["points"] - rows["lag"])).to_numpy(dtype=float)
        out = [1.0]
        for k in range(1, len(r)):
            matrix = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
            out.append(float(np.linalg.lstsq(matrix, r[1 : k + 1], rcond=None)[0][-1]))
        result = rows[names + ["lag"]].copy()
        result["pacf"] = out
        return result

    return lags.groupBy(*names).applyInPandas(solve, schema).select(*keys, "lag", "pacf")


# ---------------------------------------------------------------- ARIMA(1,1,1)


def _grid_minimum(loss, lows: Sequence[float], highs: Sequence[float], points: int, rounds: int) -> np.ndarray:
    """Minimise a vectorised loss on a box by a grid that shrinks around the best point."""
    lows, highs = np.array(lows, float), np.array(highs, float)
    low, high = lows.copy(), highs.copy()
    best = (low + high) / 2
    for _ in range(rounds):
        axes = [np.linspace(a, b, points) for a, b in zip(low, high)]
        grid = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")])
        best = grid[:, int(np.argmin(loss(*grid)))]
        span = (high - low) / (points - 1) * 1.5
        low, high = np.maximum(best - span, lows), np.minimum(best + span, highs)
    return best


def arima_parameters(y: np.ndarray) -> tuple[float, float, float, float]:
    """Conditional least squares for ARIMA(1,1,1) without constant: phi, theta, sigma2, last error."""
    w = np.diff(y)

    def errors(phi, theta):
        e = np.zeros_like(phi)
        total = np.zeros_like(phi)
        for now, before in zip(w[1:], w[:-1]):
            e = now - phi * before - theta * e
            total = total + e * e
        return e, total

    phi, theta = _grid_minimum(lambda p, t: errors(p, t)[1], [-0.99, -0.99], [0.99, 0.99], 25, 5)
    e, total = errors(np.array([phi]), np.array([theta]))
    return float(phi), float(theta), float(total[0] / max(len(w) - 1, 1)), float(e[0])


def arima_likelihood(
    series: DataFrame, phi: float, theta: float, sigma2: float, keys: Sequence[str] = (), ts: str = "ts", value: str = "value"
) -> DataFrame:
    """``(keys, n, log_likelihood)`` of the differences of each series under ARMA(1,1) with given parameters.

    Series below two points have no differences: n is 0 and the likelihood NULL.
    """
    names = list(keys) or ["_one"]
    base = series if keys else series.withColumn("_one", F.lit(0))
    base = base.select(*names, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).na.drop()
    fields = [f for f in base.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("log_likelihood", T.DoubleType())])

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        w = np.diff(rows.sort_values("ts")["value"].to_numpy())
        found = arima.log_likelihood(w, np.array([phi]), np.array([theta]), sigma2) if len(w) else None
        return rows[names].head(1).assign(n=len(w), log_likelihood=found)

    return base.groupBy(*names).applyInPandas(measure, schema).select(*keys, "n", "log_likelihood")


def arima_forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    train: float = 0.8,
    steps: int = 5,
    ts: str = "ts",
    value: str = "value",
    method: str = "likelihood",
) -> DataFrame:
    """Fit ARIMA(1,1,1) on the first 80 % of each series and forecast the rest.

    Returns ``(keys, step, ts, actual, forecast, phi, theta, sigma2)``; ``steps`` applies when
    nothing is left to test. Series below 10 points give one row of NULLs. ``method`` is the exact
    ``likelihood`` or ``conditional`` least squares.
    """
    if method not in ("likelihood", "conditional"):
        raise ValueError(f"unknown method {method}")
    names = list(keys) or ["_one"]
    base = series if keys else series.withColumn("_one", F.lit(0))
    base = base.select(*names, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).na.drop()
    fields = [f for f in base.schema.fields if f.name in names]
    numbers = ["actual", "forecast", "phi", "theta", "sigma2"]
    schema = T.StructType(
        [*fields, T.StructField("step", T.IntegerType()), T.StructField("ts", base.schema["ts"].dataType)]
        + [T.StructField(n, T.DoubleType()) for n in numbers]
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        y = rows["value"].to_numpy()
        cut = int(len(y) * train)
        if len(y) < MIN_POINTS["forecast"] or cut < 4:
            return _too_short(rows, names, schema)
        ahead = len(y) - cut or steps
        if method == "likelihood":
            model = arima.fit(y[:cut])
            phi, theta, sigma2 = float(model.ar[0]), float(model.ma[0]), model.sigma2
            forecast = model.forecast(ahead)[0]
        else:
            phi, theta, sigma2, error = arima_parameters(y[:cut])
            move = phi * (y[cut - 1] - y[cut - 2]) + theta * error
            forecast = y[cut - 1] + np.cumsum(move * phi ** np.arange(ahead))
        actual = np.full(ahead, np.nan)
        actual[: len(y) - cut] = y[cut:]
        out = pd.DataFrame({n: [rows[n].iloc[0]] * ahead for n in names})
        out["step"] = np.arange(1, ahead + 1)
        out["ts"] = list(rows["ts"].iloc[cut:]) + [None] * (ahead - (len(y) - cut))
        out["actual"], out["forecast"] = actual, forecast
        out["phi"], out["theta"], out["sigma2"] = phi, theta, sigma2
        return out

    fitted = base.groupBy(*names).applyInPandas(fit, schema)
    clean = F.when(~F.isnan("actual"), F.col("actual"))
    return fitted.withColumn("actual", clean).select(*keys, "step", "ts", *numbers)


# ---------------------------------------------------------------- Holt-Winters


def holt_winters_fit(y: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smoothing weights with the least squared one-step error, and the final state."""
    first, second = y[:season].mean(), y[season : 2 * season].mean()

    def run(alpha, beta, gamma):
        level = np.full(alpha.shape, first)
        trend = np.full(alpha.shape, (second - first) / season)
        seasonal = np.repeat((y[:season] - first)[:, None], alpha.size, axis=1)
        total = np.zeros(alpha.shape)
        for t, value in enumerate(y):
            s = seasonal[t % season].copy()
            error = value - level - trend - s
            total += error * error
            new_level = alpha * (value - s) + (1 - alpha) * (level + trend)
            trend = beta * (new_level - level) + (1 - beta) * trend
            seasonal[t % season] = gamma * (value - new_level) + (1 - gamma) * s
            level = new_level
        return total, level, trend, seasonal

    weights = _grid_minimum(lambda a, b, g: run(a, b, g)[0], [0.0] * 3, [1.0] * 3, 9, 5)
    total, level, trend, seasonal = run(*[np.array([w]) for w in weights])
    return weights, total / len(y), level, trend, seasonal


def holt_winters_forecast(
    series: DataFrame, keys: Sequence[str] = (), season: int = 12, steps: int = 6, ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Additive trend and season; ``(keys, step, forecast, mse, alpha, beta, gamma)``.

    Series shorter than two seasons give one row of NULLs.
    """
    names = list(keys) or ["_one"]
    base = series if keys else series.withColumn("_one", F.lit(0))
    base = base.select(*names, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).na.drop()
    fields = [f for f in base.schema.fields if f.name in names]
    numbers = ["forecast", "mse", "alpha", "beta", "gamma"]
    schema = T.StructType(
        [*fields, T.StructField("step", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in numbers]
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("ts")["value"].to_numpy()
        if len(y) < 2 * season:
            return _too_short(rows, names, schema)
        weights, mse, level, trend, seasonal = holt_winters_fit(y, season)
        h = np.arange(1, steps + 1)
        out = pd.DataFrame({n: [rows[n].iloc[0]] * steps for n in names})
        out["step"] = h
        out["forecast"] = level[0] + h * trend[0] + seasonal[(len(y) + h - 1) % season, 0]
        out["mse"] = mse[0]
        out["alpha"], out["beta"], out["gamma"] = weights
        return out

    return base.groupBy(*names).applyInPandas(fit, schema).select(*keys, "step", *numbers)


# ---------------------------------------------------------------- trend and yearly season


def trend_season_forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    steps: int = 6,
    order: int = 3,
    ts: str = "ts",
    value: str = "value",
    interval: float = 1.2816,
) -> DataFrame:
    """Straight trend plus ``order`` yearly Fourier waves per series by least squares; monthly steps ahead.

    Returns ``(keys, step, ts, forecast, lower_bound, upper_bound)``; the bounds span 80 % of a normal
    residual. There are no trend change points. Spark adds up the normal equations of all series in one
    aggregation; a task then solves one small system per series. Series with fewer points than terms
    get NULL forecasts.
    """
    names = list(keys) or ["_one"]
    base = series if keys else series.withColumn("_one", F.lit(0))
    points = base.select(*names, F.to_date(ts).alias("_day"), F.col(value).cast("double").alias("_y")).where(
        "_day is not null and _y is not null and not isnan(_y)"
    )
    spans = points.groupBy(*names).agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi"))

    def terms() -> list[Column]:
        years = F.date_diff("_day", "_lo") / F.lit(365.25)
        angle = 2 * F.pi() * years
        return [F.lit(1.0), years, *[f(angle * k) for k in range(1, order + 1) for f in (F.sin, F.cos)]]

    size = 2 + 2 * order
    x = [F.col("_x")[i] for i in range(size)]
    sums = (
        null_safe_join(points, spans, names)
        .withColumn("_x", F.array(*terms()))
        .groupBy(*names)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.col("_y") * F.col("_y")).alias("_yy"),
            F.array(*[F.sum(F.col("_y") * a) for a in x]).alias("_xy"),
            F.array(*[F.sum(a * b) for a in x for b in x]).alias("_xx"),
        )
    )
    fields = [f for f in base.schema.fields if f.name in names]
    solved = T.StructType([*fields, T.StructField("_b", T.ArrayType(T.DoubleType())), T.StructField("_rmse", T.DoubleType())])

    def solve(batches):
        for rows in batches:
            coefficients, errors = [], []
            for n, yy, xy, xx in zip(rows["_n"], rows["_yy"], rows["_xy"], rows["_xx"]):
                if n < size:
                    coefficients.append(None)
                    errors.append(None)
                    continue
                b = np.linalg.lstsq(np.reshape(xx, (size, size)), np.asarray(xy), rcond=None)[0]
                coefficients.append(b)
                errors.append(float(np.sqrt(max(0.0, yy - b @ xy) / n)))
            yield rows[names].assign(_b=coefficients, _rmse=errors)

    models = null_safe_join(sums.mapInPandas(solve, solved), spans, names)
    ahead = models.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    dated = ahead.withColumn("_day", F.add_months("_hi", F.col("step")))
    forecast = sum((F.col("_b")[i] * term for i, term in enumerate(terms())), F.lit(0.0))
    margin = F.lit(interval) * F.col("_rmse")
    return dated.withColumn("forecast", forecast).select(
        *keys,
        "step",
        F.col("_day").alias("ts"),
        "forecast",
        (F.col("forecast") - margin).alias("lower_bound"),
        (F.col("forecast") + margin).alias("upper_bound"),
    )
