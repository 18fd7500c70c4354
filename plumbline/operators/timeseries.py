"""Time-series analyses over dated rows.

``keys`` names the columns that identify a series; without keys the table is one series. Functions
that depend on the row order take a ``tie`` column list and work from exact positions (see
``functions.ordered``), so one very long series is processed by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.ordered import (
    POSITION,
    SERIES_SIZE,
    nearest_known,
    null_safe_join,
    over_neighbours,
    with_position,
)
from plumbline.functions.quantiles import clean_double, grouped_quantiles
from plumbline.functions.statistics import MICROS_PER_DAY, micros, safe_divide, whole_days
from plumbline.operators.associate import contingency
from plumbline.operators.business import group_share

# Smallest number of points for each analysis.
MIN_POINTS = {"trend": 3, "moving_average": 10, "decomposition": 12, "autocorrelation": 11, "forecast": 10}
MOVING_WINDOWS = (3, 7, 14, 30)
MAX_LAG = 10

# Default seasonal period by frequency code.
SEASON_LENGTH = {"H": 24, "D": 7, "W": 52, "M": 12, "Q": 4}


# ---------------------------------------------------------------- calendar counts


def daily_counts(df: DataFrame, date: str) -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def monthly_counts(df: DataFrame, date: str) -> DataFrame:
    dated = df.where(F.col(date).isNotNull())
    return dated.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def date_range(df: DataFrame, date: str) -> DataFrame:
    row = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return row.select(
        F.date_format("lo", "yyyy-MM-dd").alias("start"),
        F.date_format("hi", "yyyy-MM-dd").alias("end"),
        whole_days(micros(F.col("hi")) - micros(F.col("lo"))).alias("span_days"),
    )


def weekday_distribution(df: DataFrame, date: str) -> DataFrame:
    """``(day, n, pct)`` with the share of all rows."""
    shares = group_share(df.select(F.date_format(date, "EEEE").alias("day")), "day", 4)
    return shares.withColumnsRenamed({"value": "day", "share_pct": "pct"})


def calendar_grid(df: DataFrame, date: str, split_years: bool = False) -> DataFrame:
    """ISO week rows by weekday columns ``d0`` (Monday) .. ``d6``; empty below 7 days of data."""
    days = daily_counts(df, date)
    span = days.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.date_diff(F.max("day"), F.min("day")).alias("range"))
    ).scalar()
    weeks = [F.weekofyear("day").cast("long").alias("week")]
    if split_years:
        weeks.insert(0, F.extract(F.lit("YEAROFWEEK"), F.col("day")).cast("long").alias("iso_year"))
    return (
        days.where((span["n"] >= 7) & (span["range"] >= 7))
        .select(*weeks, F.weekday("day").alias("weekday"), "n")
        .groupBy(*(["iso_year", "week"] if split_years else ["week"]))
        .agg(*[F.coalesce(F.sum(F.when(F.col("weekday") == d, F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(7)])
    )


def monthly_totals(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """``(month, total)`` with a row of 0 for empty months; counts rows unless ``value`` is given."""
    amount = F.count(F.lit(1)) if value is None else F.sum(clean_double(value))
    dated = df.where(F.col(date).isNotNull())
    sums = dated.groupBy(F.trunc(F.to_date(date), "month").alias("month")).agg(amount.alias("total"))
    span = dated.agg(F.to_date(F.min(date)).alias("lo"), F.to_date(F.max(date)).alias("hi"))
    months = span.where("lo is not null").select(
        F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("month")
    )
    return months.join(sums, "month", "left").select("month", F.coalesce("total", F.lit(0)).alias("total"))


def period_category_counts(df: DataFrame, date: str, category: str, grain: str | None = None) -> DataFrame:
    """Counts per period and category; ``grain`` is day, month or quarter, else it follows the span of the dates."""
    day = F.to_date(date)
    if grain is None:
        span = df.agg(whole_days(micros(F.max(date)) - micros(F.min(date)))).scalar()
        period = F.when(span <= 31, day).when(span <= 365, F.trunc(day, "month")).otherwise(F.trunc(day, "quarter"))
    else:
        period = day if grain == "day" else F.trunc(day, grain)
    return contingency(df.withColumn("_period", period), "_period", category).select(
        F.col("row_value").alias("period"), F.col("col_value").alias("category"), "n"
    )


# ---------------------------------------------------------------- series construction


def daily_series(
    df: DataFrame, date: str, value: str, keys: Sequence[str] = (), aggregate: str = "sum", grain: str = "day"
) -> DataFrame:
    """``(keys, ts, value)`` at one row per day or month: the length is bounded by the calendar."""
    ts = F.to_date(date) if grain == "day" else F.trunc(F.to_date(date), grain)
    function = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max, "min": F.min}[aggregate]
    x = clean_double(value)
    points = df.where(F.col(date).isNotNull() & x.isNotNull()).groupBy(*keys, ts.alias("ts"))
    return points.agg(function(x).cast("double").alias("value"))


def _points(df: DataFrame, date: str, value: str | None, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Complete (date, value) rows with their position in date order."""
    x = [] if value is None else [clean_double(value).alias("_v")]
    ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)]
    rows = df.select(*keys, F.col(date).alias("_ts"), *x, *ties).where("_ts is not null")
    if value is not None:
        rows = rows.where("_v is not null")
    return with_position(rows, ["_ts", *[f"_tie{i}" for i in range(len(tie))]], keys)


def _gaps(df: DataFrame, date: str, keys: Sequence[str], distinct: bool, tie: Sequence[str]) -> DataFrame:
    """``(keys, _gap)``: microseconds between neighbouring timestamps in order."""
    source = df.select(*keys, date).where(F.col(date).isNotNull())
    if distinct:
        placed = _points(source.distinct(), date, None, keys, ())
    else:
        placed = _points(df, date, None, keys, tie)
    gap = lambda w: {"_gap": micros(F.col("_ts")) - micros(F.lag("_ts").over(w))}
    return over_neighbours(placed, gap, before=1, keys=keys).where("_gap is not null")


def _series_names(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct() if keys else df.sparkSession.range(1).select(F.lit(0).alias("_one"))


def frequency_code(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, frequency)`` from the median gap between distinct timestamps; NULL below two of them."""
    names = list(keys) or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(0))
    medians = grouped_quantiles(_gaps(base, date, names, True, ()), names, "_gap", [0.5])
    gap = F.col("quantiles")[0]
    days, hours = whole_days(gap), gap / F.lit(3_600_000_000)
    code = (
        F.when(days == 0, F.when(hours <= 1, "H").when(hours <= 6, "6H").otherwise("D"))
        .when(days < 2, "D")
        .when(days < 8, "W")
        .when(days < 16, "2W")
        .when(days < 35, "M")
        .when(days < 100, "Q")
        .otherwise("A")
    )
    codes = medians.select(*names, F.when(gap.isNotNull(), code).alias("frequency"))
    joined = null_safe_join(_series_names(base, names), codes, names, "left")
    return joined.select(*keys, "frequency")


def frequency_label(df: DataFrame, date: str, keys: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """``(keys, frequency)`` in words, from the median whole-day gap between sorted rows."""
    names = list(keys) or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(0))
    gaps = _gaps(base, date, names, False, tie).withColumn("_gap", whole_days(F.col("_gap")))
    medians = grouped_quantiles(gaps, names, "_gap", [0.5])
    m = F.col("quantiles")[0]
    label = (
        F.when(m <= 1, "Daily")
        .when(m.between(6, 8), "Weekly")
        .when(m.between(28, 31), "Monthly")
        .when(m.between(90, 92), "Quarterly")
        .when(m.between(365, 366), "Yearly")
        .otherwise(F.concat(F.lit("Approximately every "), m.cast("int").cast("string"), F.lit(" days")))
    )
    labels = medians.select(*names, label.alias("frequency"))
    joined = null_safe_join(_series_names(base, names), labels, names, "left")
    return joined.select(*keys, F.coalesce("frequency", F.lit("Insufficient data points")).alias("frequency"))


def series_metrics(df: DataFrame, date: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Points, extremes, mean, exact median, sample std and frequency code of every series."""
    names = list(keys) or ["_one"]
    base = (df if keys else df.withColumn("_one", F.lit(0))).where(
        F.col(date).isNotNull() & clean_double(value).isNotNull()
    )
    x = clean_double(value)
    facts = base.groupBy(*names).agg(
        F.count(x).alias("points"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
    )
    medians = grouped_quantiles(base, names, value, [0.5]).select(*names, F.col("quantiles")[0].alias("median"))
    codes = frequency_code(base, date, names)
    joined = null_safe_join(null_safe_join(facts, medians, names, "left"), codes, names, "left")
    return joined.select(*keys, "points", "min", "max", "mean", "median", "std", "frequency")


# ---------------------------------------------------------------- row-order analyses


def moving_averages(
    df: DataFrame,
    date: str,
    value: str,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    windows: Sequence[int] = MOVING_WINDOWS,
) -> DataFrame:
    """Trailing means ``ma_<w>``, NULL until the window is full and for series below 10 points."""
    placed = _points(df, date, value, keys, tie)
    enough = F.col(SERIES_SIZE) >= MIN_POINTS["moving_average"]

    def means(w) -> dict[str, Column]:
        result = {}
        for size in windows:
            full = enough & (F.col(POSITION) >= size - 1) & (F.col(SERIES_SIZE) > size)
            result[f"ma_{size}"] = F.when(full, F.avg("_v").over(w.rowsBetween(-(size - 1), 0)))
        return result

    rows = over_neighbours(placed, means, before=max(windows) - 1, keys=keys)
    return rows.select(
        *keys,
        F.col("_ts").alias("ts"),
        F.col(POSITION).alias("position"),
        F.col("_v").alias("value"),
        *[f"ma_{size}" for size in windows],
    )


def smoothed_trend(
    df: DataFrame, date: str, value: str, keys: Sequence[str] = (), tie: Sequence[str] = (), width: int = 11
) -> DataFrame:
    """First-order Savitzky-Golay smoothing over ``width`` rows; shorter series have a NULL trend.

    The centre of a fitted line is the mean of its window; the first and last rows lie on the line
    fitted to the first and last ``width`` rows.
    """
    half = width // 2
    placed = _points(df, date, value, keys, tie)
    mean = lambda w: {"_mean": F.avg("_v").over(w.rowsBetween(-half, half))}
    rows = over_neighbours(placed, mean, before=half, after=half, keys=keys)
    names = list(keys) or ["_one"]
    rows = rows if keys else rows.withColumn("_one", F.lit(0))
    head, tail = F.col(POSITION) < width, F.col(POSITION) >= F.col(SERIES_SIZE) - width
    at = F.col(POSITION).cast("double")
    from_end = (F.col(POSITION) - F.col(SERIES_SIZE)).cast("double")
    lines = (
        rows.where(head | tail)
        .groupBy(*names)
        .agg(
            F.regr_slope(F.when(head, F.col("_v")), at).alias("_hs"),
            F.regr_intercept(F.when(head, F.col("_v")), at).alias("_hi"),
            F.regr_slope(F.when(tail, F.col("_v")), from_end).alias("_ts_"),
            F.regr_intercept(F.when(tail, F.col("_v")), from_end).alias("_ti"),
        )
    )
    smooth = (
        F.when(F.col(SERIES_SIZE) < width, F.lit(None).cast("double"))
        .when(F.col(POSITION) < half, F.col("_hi") + F.col("_hs") * at)
        .when(F.col(POSITION) >= F.col(SERIES_SIZE) - half, F.col("_ti") + F.col("_ts_") * from_end)
        .otherwise(F.col("_mean"))
    )
    return null_safe_join(rows, lines, names).select(
        *keys,
        F.col("_ts").alias("ts"),
        F.col(POSITION).alias("position"),
        F.col("_v").alias("value"),
        smooth.alias("trend"),
    )


def autocorrelation(
    df: DataFrame,
    date: str,
    value: str,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    max_lag: int = MAX_LAG,
    covariances: bool = False,
) -> DataFrame:
    """``(keys, lag, acf)`` for lags 0..min(max_lag, n // 2); NULL for series of 10 points or fewer."""
    names = list(keys) or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(0))
    placed = _points(base, date, value, names, tie)
    means = placed.groupBy(*names).agg(F.avg("_v").alias("_m"))
    centred = null_safe_join(placed, means, names).withColumn("_d", F.col("_v") - F.col("_m"))

    def products(w) -> dict[str, Column]:
        return {f"_p{k}": F.col("_d") * (F.lag("_d", k).over(w) if k else F.col("_d")) for k in range(max_lag + 1)}

    sums = (
        over_neighbours(centred, products, before=max_lag, keys=names)
        .groupBy(*names)
        .agg(F.max(SERIES_SIZE).alias("_n"), *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(max_lag + 1)])
    )
    lags = F.array(
        *[F.struct(F.lit(k).alias("lag"), F.coalesce(f"_s{k}", F.lit(0.0)).alias("_sum")) for k in range(max_lag + 1)]
    )
    rows = sums.select(*names, "_n", "_s0", F.inline(lags)).where(F.col("lag") <= F.floor(F.col("_n") / 2))
    extra = [F.col("_sum").alias("covariance_sum"), F.col("_n").alias("points")] if covariances else []
    acf = F.when(F.col("_n") >= MIN_POINTS["autocorrelation"], safe_divide(F.col("_sum"), F.col("_s0")))
    return rows.select(*keys, "lag", acf.alias("acf"), *extra)


def significant_lags(acf: DataFrame, keys: Sequence[str] = (), limit: float = 0.3) -> DataFrame:
    """``(keys, significant_lags, has_autocorrelation)`` from an autocorrelation table."""
    strong = F.when((F.col("lag") > 0) & (F.abs("acf") > limit), F.col("lag"))
    return acf.groupBy(*keys).agg(F.array_sort(F.collect_list(strong)).alias("significant_lags")).withColumn(
        "has_autocorrelation", F.size("significant_lags") > 0
    )


def chronological_split(
    df: DataFrame, date: str, keys: Sequence[str] = (), tie: Sequence[str] = (), train: float = 0.8
) -> DataFrame:
    """All rows in date order with ``part`` = train for the first 80 % of a series, else test."""
    placed = with_position(df.where(F.col(date).isNotNull()), [date, *tie], keys)
    cut = F.floor(F.col(SERIES_SIZE) * F.lit(train))
    return placed.withColumn("part", F.when(F.col(POSITION) < cut, "train").otherwise("test")).drop(
        POSITION, SERIES_SIZE
    )


def change_metrics(
    df: DataFrame, date: str, value: str, keys: Sequence[str] = (), tie: Sequence[str] = ()
) -> DataFrame:
    """Start, end, extremes, total and mean change and the volatility of the percentage change.

    A series of one point has no change: total 0, means and volatility NULL.
    """
    placed = _points(df, date, value, keys, tie)
    previous = lambda w: {"_prev": F.lag("_v").over(w)}
    rows = over_neighbours(placed, previous, before=1, keys=keys)
    change = F.col("_v") - F.col("_prev")
    pct = (safe_divide(F.col("_v"), F.col("_prev")) - 1) * 100
    first, last = F.min_by("_v", POSITION), F.max_by("_v", POSITION)
    return rows.groupBy(*keys).agg(
        first.alias("start_value"),
        last.alias("end_value"),
        F.min("_v").alias("min_value"),
        F.max("_v").alias("max_value"),
        (last - first).alias("total_change"),
        ((safe_divide(last, first) - 1) * 100).alias("pct_total_change"),
        F.avg(change).alias("avg_change"),
        F.avg(pct).alias("avg_pct_change"),
        F.stddev_samp(pct).alias("volatility"),
    )


# ---------------------------------------------------------------- regular series


def regularize(
    series: DataFrame, keys: Sequence[str] = (), step: str = "1 day", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """One row per step between the first and last date; gaps are filled linearly.

    ``series`` holds one row per key and date. Leading gaps stay NULL, trailing ones keep the last value.
    """
    span = series.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = span.where("_lo is not null").select(
        *keys, F.posexplode(F.sequence(F.col("_lo"), F.col("_hi"), F.expr(f"interval {step}"))).alias("_i", ts)
    )
    full = null_safe_join(grid, series.select(*keys, ts, F.col(value).alias("_v")), [*keys, ts], "left")
    known = full.withColumn("_k", F.when(F.col("_v").isNotNull(), F.struct("_i", "_v")))
    placed = nearest_known(known, ["_k"], ["_i"], keys)
    b, a = F.col("_before__k"), F.col("_after__k")
    weight = safe_divide(F.col("_i") - b["_i"], a["_i"] - b["_i"])
    filled = F.coalesce(F.col("_v"), b["_v"] + (a["_v"] - b["_v"]) * weight, b["_v"])
    return placed.select(
        *keys, ts, F.col("_i").cast("long").alias("idx"), filled.alias(value), F.col("_v").isNull().alias("was_gap")
    )


def decompose(
    regular: DataFrame, period: int, keys: Sequence[str] = (), value: str = "value", idx: str = "idx"
) -> DataFrame:
    """Additive trend, seasonal and residual parts of a regular series of at least two periods.

    ``idx`` counts the rows of a series from 0. ``status`` is ``not enough points`` for shorter series,
    whose parts are NULL. Centred means are taken over chunks of a series, not the whole of it.
    """
    names = list(keys) or ["_one"]
    base = regular if keys else regular.withColumn("_one", F.lit(0))
    sizes = base.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    placed = null_safe_join(base.withColumn(POSITION, F.col(idx)), sizes, names)
    half = period // 2

    def means(w) -> dict[str, Column]:
        if period % 2:
            return {"_mean": F.avg(value).over(w.rowsBetween(-half, half))}
        ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        return {"_mean": (F.sum(value).over(w.rowsBetween(-(half - 1), half - 1)) + ends) / period}

    enough = F.col("_n") >= F.lit(max(2 * period, MIN_POINTS["decomposition"]))
    inner = enough & (F.col(idx) >= half) & (F.col(idx) < F.col("_n") - half)
    trended = over_neighbours(placed, means, before=half, after=half, keys=names).withColumns(
        {
            "trend": F.when(inner, F.col("_mean")),
            "status": F.when(enough, "ok").otherwise("not enough points"),
            "_phase": F.pmod(F.col(idx), F.lit(period)),
        }
    )
    phases = trended.where(F.col("trend").isNotNull()).groupBy(*names, "_phase").agg(
        F.avg(F.col(value) - F.col("trend")).alias("_raw")
    )
    # At most one row per phase here.
    effects = phases.withColumn("seasonal", F.col("_raw") - F.avg("_raw").over(W.partitionBy(*names))).drop("_raw")
    joined = null_safe_join(trended, effects, [*names, "_phase"], "left")
    parts = joined.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
    return parts.select(*regular.columns, "trend", "status", "seasonal", "residual")


def seasonal_strength(parts: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``(keys, seasonal_strength, has_seasonality)`` from a decomposition."""
    ratio = safe_divide(F.avg(F.abs("seasonal")), F.avg(F.abs(value)))
    return parts.groupBy(*keys).agg(ratio.alias("seasonal_strength")).withColumn(
        "has_seasonality", F.coalesce(F.col("seasonal_strength") > 0.1, F.lit(False))
    )


def trend_summary(df: DataFrame, date: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope per day, r-squared, strength and direction of a straight line; NULL for short series."""
    day = (micros(F.col(date)) / F.lit(MICROS_PER_DAY)).cast("double")
    start = df.agg(F.min(micros(F.col(date)))).scalar() / F.lit(MICROS_PER_DAY)
    x = day - start
    y = clean_double(value)
    fit = df.groupBy(*keys).agg(
        F.count_if(x.isNotNull() & y.isNotNull()).alias("points"),
        F.regr_slope(y, x).alias("slope_per_day"),
        F.regr_r2(y, x).alias("r2"),
    )
    r2, slope = F.col("r2"), F.col("slope_per_day")
    strength = F.when(r2 >= 0.5, "Strong").when(r2 >= 0.2, "Moderate").otherwise("Weak")
    direction = F.when(slope > 0, "Upward").when(slope < 0, "Downward").otherwise("Flat")
    enough = F.col("points") >= MIN_POINTS["trend"]
    return fit.select(
        *keys,
        "points",
        *[F.when(enough, e).alias(n) for n, e in (("slope_per_day", slope), ("r2", r2), ("strength", strength), ("direction", direction))],
    )


# ---------------------------------------------------------------- readiness and horizon

# Readiness grades by number of points and the models advised for each.
READINESS = [(10, "Poor"), (30, "Fair"), (100, "Good")]
READINESS_TOP = "Excellent"
MODEL_ADVICE = [
    ("Poor", "Moving Average", "Limited", "Low"),
    ("Poor", "Naive Forecast", "Limited", "Low"),
    ("Fair", "Exponential Smoothing", "Moderate", "Low"),
    ("Fair", "ARIMA", "Moderate", "Medium"),
    ("Good", "SARIMA", "Good", "Medium"),
    ("Good", "Prophet", "Good", "Medium"),
    ("Excellent", "Prophet", "Excellent", "Medium"),
    ("Excellent", "LSTM", "Excellent", "High"),
    ("Excellent", "XGBoost", "Excellent", "High"),
]
# Horizon texts by span (upper limit in days, short, medium, long, advice).
HORIZONS = [
    ("none", "1-2 periods", "Not recommended", "Not recommended", "Insufficient data for reliable forecasting"),
    ("month", "1-3 days", "Up to 1 week", "Not recommended", "Focus on short-term forecasting only"),
    ("year", "1-2 weeks", "Up to 1 month", "Up to 3 months", "Medium-term forecasting may be reliable"),
    ("longer", "Up to 1 month", "Up to 3 months", "Up to 1 year", "Data supports longer-term forecasting"),
]


def forecast_readiness(df: DataFrame, date: str, value: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, data_points, quality)`` from the number of complete points."""
    known = F.col(date).isNotNull()
    if value is not None:
        known = known & clean_double(value).isNotNull()
    points = F.col("data_points")
    quality = F.when(points < READINESS[0][0], READINESS[0][1])
    for limit, grade in READINESS[1:]:
        quality = quality.when(points < limit, grade)
    return df.groupBy(*keys).agg(F.count_if(known).alias("data_points")).withColumn(
        "quality", quality.otherwise(READINESS_TOP)
    )


def suggest_models(readiness: DataFrame) -> DataFrame:
    """The advised models for every row of a readiness table."""
    advice = readiness.sparkSession.createDataFrame(
        MODEL_ADVICE, "quality string, model string, suitability string, complexity string"
    )
    return readiness.join(F.broadcast(advice), "quality")


def forecast_horizon(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """Advised horizons by the span of the dates."""
    span = df.groupBy(*keys).agg(
        F.count(date).alias("dates"),
        whole_days(micros(F.max(date)) - micros(F.min(date))).alias("span_days"),
    )
    level = (
        F.when(F.col("dates") < 2, "none")
        .when(F.col("span_days") < 30, "month")
        .when(F.col("span_days") < 365, "year")
        .otherwise("longer")
    )
    texts = df.sparkSession.createDataFrame(
        HORIZONS, "_level string, short_term string, medium_term string, long_term string, recommendation string"
    )
    return span.withColumn("_level", level).join(F.broadcast(texts), "_level").drop("_level", "dates")


def forecast_limitations(
    df: DataFrame, date: str, value: str, keys: Sequence[str] = (), tie: Sequence[str] = ()
) -> DataFrame:
    """``(keys, limitations)``: few points, large gaps, less than a year of rows, or the generic one."""
    names = list(keys) or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(0))
    facts = base.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col(date).isNotNull() & clean_double(value).isNotNull()).alias("_points"),
    )
    widest = _gaps(base, date, names, True, ()).groupBy(*names).agg(whole_days(F.max("_gap")).alias("_gap_days"))
    gap_text = F.concat(
        F.lit("Large gaps in time series (max gap: "), F.col("_gap_days").cast("string"), F.lit(" days)")
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("_points") < 30, F.lit("Limited historical data points")),
            F.when(F.col("_gap_days") > 30, gap_text),
            F.when(F.col("_rows") < 365, F.lit("Insufficient data to capture annual seasonality")),
        )
    )
    generic = F.lit("Standard forecasting uncertainty applies")
    rows = null_safe_join(facts, widest, names, "left").withColumn("_found", found)
    texts = F.when(F.size("_found") < 2, F.array_append("_found", generic)).otherwise(F.col("_found"))
    return rows.select(*keys, texts.alias("limitations"))


def analysis_gates(df: DataFrame, date: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, points, analysis, status)``: which analyses each series is long enough for."""
    known = F.col(date).isNotNull() & clean_double(value).isNotNull()
    points = df.groupBy(*keys).agg(F.count_if(known).alias("points"))
    gates = F.array(
        *[F.struct(F.lit(name).alias("analysis"), F.lit(least).alias("_least")) for name, least in MIN_POINTS.items()]
    )
    status = F.when(F.col("points") >= F.col("_least"), "ok").otherwise("not enough points")
    return points.select(*keys, "points", F.inline(gates)).select(*keys, "points", "analysis", status.alias("status"))
