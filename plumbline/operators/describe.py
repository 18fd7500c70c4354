"""Per-column summaries, distributions and outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.quantiles import (
    clean_double,
    column_statistics,
    number,
    quantile_aggregates,
)
from plumbline.functions.statistics import micros, safe_divide, sample_kurtosis, sample_skewness, whole_days
from plumbline.operators.clean import column_modes
from plumbline.operators.schema import distinct_counts, one_row_to_long, value_counts


def numeric_describe(df: DataFrame, columns: Sequence[str], extended: bool = False) -> DataFrame:
    """One row per column: count, mean, sample std, min, quartiles, max (+ skewness and kurtosis)."""
    quartiles = quantile_aggregates(df, columns, [0.25, 0.5, 0.75])
    metrics = []
    for i, c in enumerate(columns):
        x = clean_double(c)
        parts = {
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "q": quartiles[c],
            "max": F.max(x),
        }
        if extended:
            parts |= {"skewness": sample_skewness(x), "kurtosis": sample_kurtosis(x)}
        metrics.append(F.struct(*[e.alias(name) for name, e in parts.items()]).alias(f"c{i}"))
    row = df.agg(*metrics)

    def fields(i: int, c: str) -> Column:
        s = F.col(f"c{i}")
        out = [F.lit(c).alias("column"), s["count"].alias("count"), s["mean"].alias("mean"), s["std"].alias("std")]
        out += [s["min"].alias("min"), s["q"][0].alias("q1"), s["q"][1].alias("median"), s["q"][2].alias("q3")]
        out.append(s["max"].alias("max"))
        if extended:
            out += [s["skewness"].alias("skewness"), s["kurtosis"].alias("kurtosis")]
        return F.struct(*out)

    return one_row_to_long(row, [fields(i, c) for i, c in enumerate(columns)])


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, unique_values, most_common, most_common_count, most_common_pct)`` (of all rows)."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("unique_values"), best.alias("b"))
        .select(
            "column",
            "unique_values",
            F.col("b.value").alias("most_common"),
            F.col("b.n").alias("most_common_count"),
            F.round(safe_divide(F.col("b.n") * 100, rows), 2).alias("most_common_pct"),
        )
    )


def top_categories(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each column with their share of all rows."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    best = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        value_counts(df, columns)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("column", "value", "n", "rank", F.round(safe_divide(F.col("n") * 100, rows), 2).alias("pct"))
    )


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` of the known values, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def share_table(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """``(value, n, pct)`` with percentages of the known values."""
    counted = (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    known = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("pct", F.round(safe_divide(F.col("n") * 100, known), digits))


def datetime_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, first, last, range_days, unique_dates)``; the range is in whole 24-hour days."""
    row = df.agg(
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)],
    )
    ends = one_row_to_long(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.date_format(f"lo{i}", "yyyy-MM-dd").alias("first"),
                F.date_format(f"hi{i}", "yyyy-MM-dd").alias("last"),
                whole_days(micros(F.col(f"hi{i}")) - micros(F.col(f"lo{i}"))).alias("range_days"),
            )
            for i, c in enumerate(columns)
        ],
    )
    dates = df.select(*[F.to_date(c).alias(c) for c in columns])
    unique = distinct_counts(dates, columns).withColumnRenamed("distinct_values", "unique_dates")
    return ends.join(F.broadcast(unique), "column")


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """``(bin, lower, upper, n)`` over equal-width bins, empty bins included; no rows for an empty column.

    Without ``bins`` the width is the smaller of the Sturges and Freedman-Diaconis widths. The few
    numbers that fix the bins are computed first, the counts are one aggregation.
    """
    x = clean_double(column)
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    number_of_bins = bins or 1
    if bins is None and n and high > low:
        q1, q3 = df.agg(quantile_aggregates(df, [column], [0.25, 0.75])[column]).first()[0]
        widths = [(high - low) / (math.log2(n) + 1), 2 * (q3 - q1) / n ** (1 / 3)]
        number_of_bins = math.ceil((high - low) / min(w for w in widths if w > 0))
    size = (high - low) / number_of_bins if n else 0.0
    place = F.floor((x - F.lit(low)) / F.lit(size)) if size else F.lit(0)
    counts = (
        df.where(x.isNotNull())
        .groupBy(F.least(place, F.lit(number_of_bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = df.sparkSession.range(number_of_bins if n else 0).select(F.col("id").cast("int").alias("bin"))
    start = number(low)
    return edges.join(counts, "bin", "left").select(
        "bin",
        (start + F.col("bin") * F.lit(size)).alias("lower"),
        (start + (F.col("bin") + 1) * F.lit(size)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def density_curve(df: DataFrame, column: str, points: int = 200, cells: int | None = None) -> DataFrame:
    """Gaussian kernel density ``(grid, x, density)`` on ``points`` even places from the least to the largest value.

    Rows are counted in cells of an eighth of the bandwidth, each standing at the mean of its values and
    met with the places within nine bandwidths only. ``cells`` asks for the curve of data that are rounded
    to the centres of so many equal cells of the range instead.
    """
    x = clean_double(column)
    n, std, low, high = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    bandwidth = (std or 0.0) * max(n, 1) ** -0.2
    step = (high - low) / (points - 1) if n else 0.0
    if cells:
        counted = histogram(df, column, cells).where("n > 0").select(
            ((F.col("lower") + F.col("upper")) / 2).alias("centre"), "n"
        )
    else:
        cell = F.floor((x - number(low)) / F.lit(bandwidth / 8)) if bandwidth else F.lit(0)
        counted = df.where(x.isNotNull()).groupBy(cell.alias("cell")).agg(F.avg(x).alias("centre"), F.count(F.lit(1)).alias("n"))
    first, last = F.lit(0), F.lit(points - 1)
    if bandwidth and step and not cells:
        offset, reach = F.col("centre") - number(low), F.lit(9 * bandwidth)
        first = F.greatest(first, F.ceil((offset - reach) / F.lit(step)).cast("int"))
        last = F.least(last, F.floor((offset + reach) / F.lit(step)).cast("int"))
    # Cells between two places of a wide grid reach none of them.
    met = counted.where(first <= last).select("centre", "n", F.explode(F.sequence(first, last)).alias("grid"))
    place = number(low) + (number(high) - number(low)) * F.col("grid") / (points - 1)
    u = safe_divide(place - F.col("centre"), F.lit(bandwidth))
    sums = met.withColumn("k", F.col("n") * F.exp(-u * u / 2)).groupBy("grid").agg(F.sum("k").alias("k"))
    grid = df.sparkSession.range(points if n else 0).select(F.col("id").cast("int").alias("grid"))
    total = F.coalesce("k", F.lit(0.0)) if bandwidth else F.lit(None)
    return grid.join(sums, "grid", "left").select(
        "grid", place.alias("x"), safe_divide(total, F.lit(n * bandwidth * math.sqrt(2 * math.pi))).alias("density")
    )


def _fences(q: Column, factor: float) -> tuple[Column, Column]:
    spread = q[2] - q[0]
    return q[0] - factor * spread, q[2] + factor * spread


def box_plot(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and number of points outside."""
    quartiles = quantile_aggregates(df, columns, [0.25, 0.5, 0.75])
    parts = []
    for i, c in enumerate(columns):
        x = clean_double(c)
        low, high = _fences(quartiles[c], factor)
        inside = F.when(x.between(low, high), x)
        parts.append(
            F.struct(
                F.min(inside).alias("lo"), F.max(inside).alias("hi"), F.count_if((x < low) | (x > high)).alias("out")
            ).alias(f"c{i}")
        )
    row = df.agg(*parts)
    return one_row_to_long(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                quartiles[c][0].alias("q1"),
                quartiles[c][1].alias("median"),
                quartiles[c][2].alias("q3"),
                F.col(f"c{i}")["lo"].alias("whisker_low"),
                F.col(f"c{i}")["hi"].alias("whisker_high"),
                F.col(f"c{i}")["out"].alias("fliers"),
            )
            for i, c in enumerate(columns)
        ],
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """``(column, lower_bound, upper_bound, outliers, outlier_pct)`` by the interquartile range."""
    quartiles = quantile_aggregates(df, columns, [0.25, 0.5, 0.75])
    row = df.agg(
        *[F.count(clean_double(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(is_iqr_outlier(c, quartiles[c], factor)).alias(f"o{i}") for i, c in enumerate(columns)],
    )
    return one_row_to_long(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                _fences(quartiles[c], factor)[0].alias("lower_bound"),
                _fences(quartiles[c], factor)[1].alias("upper_bound"),
                F.col(f"o{i}").alias("outliers"),
                F.round(safe_divide(F.col(f"o{i}") * 100, F.col(f"n{i}")), 4).alias("outlier_pct"),
            )
            for i, c in enumerate(columns)
        ],
    )


def is_iqr_outlier(column: str, quartiles: Column, factor: float = 1.5) -> Column:
    low, high = _fences(quartiles, factor)
    x = clean_double(column)
    return (x < low) | (x > high)


def flag_iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Add the boolean ``is_outlier`` to every row."""
    q = quantile_aggregates(df, [column], [0.25, 0.5, 0.75])[column]
    return df.withColumn("is_outlier", F.coalesce(is_iqr_outlier(column, q, factor), F.lit(False)))


def z_outliers(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """``(column, outliers, outlier_pct)``: values more than ``limit`` population std from the mean."""
    means, spreads = column_statistics(df, columns, F.avg, F.stddev_pop)
    far = lambda i, c: F.abs(safe_divide(clean_double(c) - number(means[i]), number(spreads[i]))) > limit
    row = df.agg(
        *[F.count(clean_double(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(far(i, c)).alias(f"o{i}") for i, c in enumerate(columns)],
    )
    return one_row_to_long(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"o{i}").alias("outliers"),
                F.round(safe_divide(F.col(f"o{i}") * 100, F.col(f"n{i}")), 4).alias("outlier_pct"),
            )
            for i, c in enumerate(columns)
        ],
    )


def headline_insights(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], datetime: Sequence[str]
) -> DataFrame:
    """``(insight, subject, value)``: size, averages, leading categories and date span of all columns given."""
    text = lambda c: c.cast("string")
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(clean_double(c)).alias(f"m{i}") for i, c in enumerate(numeric)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(datetime)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(datetime)],
    )
    item = lambda kind, subject, value: F.struct(
        F.lit(kind).alias("insight"), F.lit(subject).cast("string").alias("subject"), value.alias("value")
    )
    items = [item("records", None, text(F.col("rows"))), item("variables", None, F.lit(str(len(df.columns))))]
    items += [item("average", c, F.format_string("%.2f", F.col(f"m{i}"))) for i, c in enumerate(numeric)]
    if not numeric:
        items.append(item("no_numeric_columns", None, F.lit("true")))
    for i, c in enumerate(datetime):
        span = whole_days(micros(F.col(f"hi{i}")) - micros(F.col(f"lo{i}")))
        items.append(item("span_days", c, text(span)))
        items.append(item("first_date", c, F.date_format(f"lo{i}", "yyyy-MM-dd")))
        items.append(item("last_date", c, F.date_format(f"hi{i}", "yyyy-MM-dd")))
    result = one_row_to_long(row, items)
    leading = list(categorical)
    if leading:
        known = df.agg(F.struct(*[F.count(f"`{c}`").alias(c) for c in leading])).scalar()
        total = F.coalesce(*[F.when(F.col("column") == c, known[c]) for c in leading])
        share = F.format_string("%.2f", safe_divide(F.col("n") * 100, total))
        result = result.unionByName(
            column_modes(df, leading).select(
                F.lit("most_common").alias("insight"),
                F.col("column").alias("subject"),
                F.concat(F.col("value"), F.lit(" ("), share, F.lit("%)")).alias("value"),
            )
        )
    return result


def categorical_targets(df: DataFrame, columns: Sequence[str], low: int = 2, high: int = 10) -> DataFrame:
    """``(column, distinct_values, is_target)``: which text columns could be a class label."""
    return distinct_counts(df, columns).withColumn("is_target", F.col("distinct_values").between(low, high))


def suitability(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row of flags: is the table fit for regression, classification, clustering."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    if categorical:
        has_target = categorical_targets(df, categorical).agg(F.max("is_target")).scalar()
    else:
        has_target = F.lit(False)
    return rows.select(
        "rows",
        F.lit(bool(numeric)).alias("regression"),
        F.coalesce(has_target, F.lit(False)).alias("classification"),
        ((F.col("rows") >= 10) & F.lit(len(numeric) > 1)).alias("clustering"),
    )
