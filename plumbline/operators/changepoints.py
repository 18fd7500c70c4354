"""Forecasts by a trend that may change its slope, with yearly and weekly waves.

Days are summed first (number, sum and sum of squares of the values), so a series is never longer than
the calendar, however many rows a day has. The slope may change at candidate days, spread evenly over
the first part of the days that have values; an L1 penalty, whose weight follows the noise, leaves most
candidates without a change. Only the summed normal equations of a series enter the solution.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Fixed values of the model: prior scales of slope changes and of all other terms, on values scaled to 1.
CHANGE_SCALE, TERM_SCALE = 0.05, 10.0
YEAR_DAYS, WEEK_DAYS = 365.25, 7.0
WEEK_WAVES = 3


@dataclass(frozen=True)
class Trend:
    """Candidates and waves of the model; ``interval`` is the normal quantile of the bounds (80 %)."""

    changes: int = 25
    share: float = 0.8
    waves: int = 3
    interval: float = 1.2816


def penalised(xx: np.ndarray, xy: np.ndarray, l1: np.ndarray, l2: np.ndarray, start: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Minimum of ``b' xx b / 2 - xy b + l1 |b| + l2 b^2 / 2``.

    One coefficient at a time leaves zero, where the slope of the loss exceeds its penalty most. With the
    signs held, the others follow in one solution; on the way there the lowest point is taken among those
    at which a penalised coefficient reaches zero. Neighbouring candidates are nearly collinear, which this does not mind.
    """
    a, b = xx + np.diag(l2), start.copy()
    free = l1 == 0
    sign = np.where(free, 0.0, np.sign(b))
    active = free | (b != 0)
    tolerance = 1e-9 * (1 + np.abs(xy).max())

    def loss(x: np.ndarray) -> float:
        return 0.5 * x @ a @ x - xy @ x + l1 @ np.abs(x)

    for _ in range(steps):
        slope = a @ b - xy
        if np.abs((slope + l1 * sign)[active]).max(initial=0.0) <= tolerance:
            excess = np.where(active, -np.inf, np.abs(slope) - l1)
            j = int(np.argmax(excess)) if len(excess) else 0
            if not len(excess) or excess[j] <= tolerance:
                break
            active[j], sign[j] = True, -np.sign(slope[j])
        on = np.nonzero(active)[0]
        goal = np.zeros_like(b)
        goal[on] = np.linalg.lstsq(a[np.ix_(on, on)], (xy - l1 * sign)[on], rcond=None)[0]
        move = goal - b
        crossing = np.nonzero(~free & (b * goal < 0))[0]
        # A coefficient that has just left zero must not go against its sign.
        points = [b - b[k] / move[k] * move for k in crossing]
        for point, k in zip(points, crossing):
            point[k] = 0.0
        wrong = ~free & active & (b == 0) & (goal * sign < 0)
        tried = [*points, goal] if not wrong.any() else points
        best = min(tried, key=loss, default=b)
        if loss(best) > loss(b) - 1e-15 * abs(loss(b)):
            stuck = active & ~free & (b == 0)
            if not stuck.any() and np.allclose(best, b, rtol=1e-10, atol=0):
                break
            active &= ~stuck
            sign[stuck] = 0.0
            if stuck.any():
                break
        b = best
        gone = ~free & (b == 0)
        active &= ~gone
        sign = np.where(free, 0.0, np.sign(b))
    return b


@dataclass(frozen=True)
class FittedTrend:
    """Terms of one series; times are shares of its span."""

    spec: Trend
    span: float
    scale: float
    places: np.ndarray
    coefficients: np.ndarray
    sigma: float
    weekly: bool

    def design(self, days: np.ndarray) -> np.ndarray:
        t = days / self.span
        columns = [np.ones_like(t), t, *[np.maximum(0.0, t - s) for s in self.places]]
        waves = [(YEAR_DAYS, k) for k in range(1, self.spec.waves + 1)] + [(WEEK_DAYS, k) for k in range(1, WEEK_WAVES + 1) if self.weekly]
        for length, k in waves:
            angle = 2 * np.pi * k * days / length
            columns += [np.sin(angle), np.cos(angle)]
        return np.stack(columns, axis=1)

    @property
    def changes(self) -> np.ndarray:
        """Change of slope at each candidate, in value per day."""
        return self.coefficients[2 : 2 + len(self.places)] * self.scale / self.span

    def forecast(self, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point forecasts and half the width of their bounds.

        Slopes go on changing as often and as much as they did: changes come at the candidates' rate with a
        Laplace distribution of their mean size, which adds a variance that grows with the third power of time.
        """
        ahead = np.maximum(0.0, days / self.span - 1)
        size = np.abs(self.coefficients[2 : 2 + len(self.places)]).mean() if len(self.places) else 0.0
        rate = len(self.places) / self.spec.share if len(self.places) else 0.0
        variance = self.sigma**2 + 2 * size**2 * rate * ahead**3 / 3
        return self.design(days) @ self.coefficients * self.scale, self.spec.interval * np.sqrt(variance) * self.scale


def fit_trend(days: np.ndarray, n: np.ndarray, total: np.ndarray, squares: np.ndarray, spec: Trend = Trend()) -> FittedTrend | None:
    """The most likely trend of sums per day; None below three days."""
    if len(days) < 3:
        return None
    order = np.argsort(days)
    days, n, total, squares = (a[order].astype(float) for a in (days, n, total, squares))
    span, means = days[-1], total / n
    scale = float(np.abs(means).max()) or 1.0
    eligible = int(len(days) * spec.share)
    count = max(0, min(spec.changes, eligible - 1))
    places = days[np.linspace(0, eligible - 1, count + 1).round().astype(int)[1:]] / span if count else np.zeros(0)
    weekly = bool(np.diff(days).min() < WEEK_DAYS and span >= 2 * WEEK_DAYS)
    shape = FittedTrend(spec, span, scale, places, np.zeros(0), 0.0, weekly)
    x = shape.design(days)
    xx, xy, yy = x.T @ (x * n[:, None]), x.T @ (total / scale), float(squares.sum() / scale**2)
    rows, is_change = float(n.sum()), np.zeros(x.shape[1], bool)
    is_change[2 : 2 + count] = True
    variance, b = max(yy / rows, 1e-12), np.zeros(x.shape[1])
    for _ in range(30):
        l1, l2 = np.where(is_change, variance / CHANGE_SCALE, 0.0), np.where(is_change, 0.0, variance / TERM_SCALE**2)
        b = penalised(xx, xy, l1, l2, b)
        left = max(yy - 2 * b @ xy + b @ xx @ b, 0.0)
        # Zero coefficients cost no degree of freedom.
        new = max(left / max(rows - np.count_nonzero(b), 1.0), 1e-12)
        if abs(new - variance) < 1e-4 * variance:
            break
        variance = new
    return FittedTrend(spec, span, scale, places, b, float(np.sqrt(variance)), weekly)


def _daily(series: DataFrame, names: Sequence[str], ts: str, value: str) -> DataFrame:
    points = series.select(*names, F.to_date(ts).alias("_day"), F.col(value).cast("double").alias("_y"))
    known = points.where("_day is not null and _y is not null and not isnan(_y)")
    return known.groupBy(*names, "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sum"), F.sum(F.col("_y") * F.col("_y")).alias("_squares"))


def _fitted(rows: pd.DataFrame, spec: Trend) -> tuple[pd.Timestamp, pd.Timestamp, FittedTrend | None]:
    day = pd.to_datetime(rows["_day"])
    first = day.min()
    offsets = (day - first).dt.days.to_numpy()
    return first, day.max(), fit_trend(offsets, rows["_n"].to_numpy(), rows["_sum"].to_numpy(), rows["_squares"].to_numpy(), spec)


def _keyed(series: DataFrame, keys: Sequence[str]) -> tuple[list[str], DataFrame]:
    names = list(keys) or ["_one"]
    return names, series if keys else series.withColumn("_one", F.lit(0))


def change_point_forecast(
    series: DataFrame, keys: Sequence[str] = (), steps: int = 6, ts: str = "ts", value: str = "value", spec: Trend = Trend()
) -> DataFrame:
    """``(keys, step, ts, forecast, lower_bound, upper_bound)``: monthly steps after the last day of each series.

    Series with fewer than three days get NULL forecasts. NULL and NaN values are left out.
    """
    names, base = _keyed(series, keys)
    fields = [f for f in base.schema.fields if f.name in names]
    numbers = ["forecast", "lower_bound", "upper_bound"]
    schema = T.StructType([*fields, T.StructField("step", T.IntegerType()), T.StructField("ts", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in numbers])

    def ahead(rows: pd.DataFrame) -> pd.DataFrame:
        first, last, model = _fitted(rows, spec)
        dates = [last + pd.DateOffset(months=k) for k in range(1, steps + 1)]
        out = pd.DataFrame({c: [rows[c].iloc[0]] * steps for c in names})
        out["step"], out["ts"] = np.arange(1, steps + 1), [d.date() for d in dates]
        point, margin = model.forecast(np.array([(d - first).days for d in dates], float)) if model else (np.full(steps, np.nan),) * 2
        out["forecast"], out["lower_bound"], out["upper_bound"] = point, point - margin, point + margin
        return out

    found = _daily(base, names, ts, value).groupBy(*names).applyInPandas(ahead, schema)
    return found.select(*keys, "step", "ts", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in numbers])


def change_points(
    series: DataFrame, keys: Sequence[str] = (), ts: str = "ts", value: str = "value", spec: Trend = Trend(), least: float = 0.01
) -> DataFrame:
    """``(keys, ts, slope_change, share)``: the candidate days at which the slope changes, in value per day.

    ``share`` is the part of all changes of the series, by absolute size; changes below ``least`` of that
    are left out.
    """
    names, base = _keyed(series, keys)
    fields = [f for f in base.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("ts", T.DateType()), T.StructField("slope_change", T.DoubleType()), T.StructField("share", T.DoubleType())])

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        first, _, model = _fitted(rows, spec)
        changes = model.changes if model else np.zeros(0)
        total = np.abs(changes).sum()
        kept = np.nonzero(np.abs(changes) > least * total)[0] if total else np.zeros(0, int)
        out = pd.DataFrame({c: pd.Series([rows[c].iloc[0]] * len(kept), dtype=rows[c].dtype) for c in names})
        days = [(first + pd.Timedelta(days=round(model.places[k] * model.span))).date() for k in kept]
        out["ts"] = pd.Series(days, dtype=object)
        out["slope_change"], out["share"] = changes[kept], np.abs(changes[kept]) / (total or 1.0)
        return out

    return _daily(base, names, ts, value).groupBy(*names).applyInPandas(found, schema).select(*keys, "ts", "slope_change", "share")
