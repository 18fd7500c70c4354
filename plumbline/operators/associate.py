"""Correlation, normality, mutual information and contingency tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.ordered import POSITION, SERIES_SIZE, running_totals, with_position
from plumbline.functions.quantiles import clean_double, column_statistics, number, quantile_aggregates
from plumbline.functions.scratch import materialize
from plumbline.functions.statistics import (
    normal_ppf,
    normal_upper_tail,
    polynomial,
    safe_divide,
    sample_kurtosis,
    sample_skewness,
)
from plumbline.operators.schema import as_text, one_row_to_long



_PAIR_SUMS = "i int, j int, n long, x double, y double, xx double, yy double, xy double"


def pearson_pairs(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """``(feature1, feature2, correlation, n)`` for every unordered pair, pairwise complete.

    Two scans for any number of columns: means first, then the products of centred values, which a
    task adds up as matrices over its batches; one row per pair and task is shuffled.
    """
    if len(columns) < 2:
        raise ValueError("a correlation needs at least two columns")
    (means,) = column_statistics(df, columns, F.avg)
    width = len(columns)
    left, right = np.triu_indices(width, 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((6, len(left)))
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            known = ~np.isnan(values)
            z, m = np.where(known, values, 0.0), known.astype(float)
            both = [m.T @ m, z.T @ m, m.T @ z, (z * z).T @ m, m.T @ (z * z), z.T @ z]
            totals += np.stack([matrix[left, right] for matrix in both])
        n, x, y, xx, yy, xy = totals
        yield pd.DataFrame({"i": left, "j": right, "n": n.astype("int64"), "x": x, "y": y, "xx": xx, "yy": yy, "xy": xy})

    centred = df.select(*[(clean_double(c) - number(m)).alias(f"c{k}") for k, (c, m) in enumerate(zip(columns, means))])
    sums = centred.mapInPandas(products, _PAIR_SUMS).groupBy("i", "j")
    sums = sums.agg(*[F.sum(name).alias(name) for name in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    # What is left of a constant column after centring is rounding of its mean.
    rounding = F.array(*[F.lit(1e-26 * (m or 0.0) ** 2) for m in means])

    def spread(squares: str, total: str, place: str) -> Column:
        value = F.col(squares) - F.col(total) * F.col(total) / n
        return F.when(value > n * F.get(rounding, F.col(place)), value)

    r = safe_divide(
        F.col("xy") - F.col("x") * F.col("y") / n, F.sqrt(spread("xx", "x", "i") * spread("yy", "y", "j"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(names, F.col("i")).alias("feature1"),
        F.get(names, F.col("j")).alias("feature2"),
        F.round(F.when(n > 0, r), digits).alias("correlation"),
        "n",
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Long matrix ``(feature1, feature2, correlation)`` with both directions and the diagonal."""
    pairs = pearson_pairs(df, columns, digits).drop("n")
    cells = pairs.select(
        F.inline(
            F.array(
                F.struct("feature1", "feature2", "correlation"),
                F.struct(
                    F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), F.col("correlation")
                ),
            )
        )
    )
    # A column's correlation with itself is 1 unless it is constant or empty.
    diagonal = one_row_to_long(
        df.agg(*[F.var_pop(clean_double(c)).alias(f"v{i}") for i, c in enumerate(columns)]),
        [
            F.struct(
                F.lit(c).alias("feature1"),
                F.lit(c).alias("feature2"),
                F.when(F.col(f"v{i}") > 0, F.lit(1.0)).alias("correlation"),
            )
            for i, c in enumerate(columns)
        ],
    )
    return cells.unionByName(diagonal)


def significant_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.5, digits: int = 4) -> DataFrame:
    """Unordered pairs with ``|r| > threshold``, their strength and direction."""
    r = F.col("correlation")
    return (
        pearson_pairs(df, columns, digits)
        .where(F.abs(r) > threshold)
        .select(
            "feature1",
            "feature2",
            "correlation",
            F.when(F.abs(r) > 0.7, "Strong").otherwise("Moderate").alias("strength"),
            F.when(r > 0, "Positive").otherwise("Negative").alias("direction"),
        )
    )


def significant_pair_map(df: DataFrame, columns: Sequence[str], threshold: float = 0.5, digits: int = 3) -> DataFrame:
    """``(pair, correlation)`` in both directions, named ``a_vs_b``."""
    return (
        correlation_matrix(df, columns, digits)
        .where((F.col("feature1") != F.col("feature2")) & (F.abs("correlation") > threshold))
        .select(F.concat_ws("_vs_", "feature1", "feature2").alias("pair"), "correlation")
    )


def _average_ranks(counted: DataFrame, value: str, weight: str, name: str) -> DataFrame:
    """``(value, rank)``: the average rank of every distinct value, from its row count."""
    sizes = counted.groupBy(F.col(value).alias("_value")).agg(F.sum(weight).alias("_w"))
    upto = running_totals(sizes, {"_upto": "_w"}, ["_value"])
    return upto.select("_value", (F.col("_upto") - (F.col("_w") - 1) / 2).alias(name))


def spearman(df: DataFrame, left: str, right: str, digits: int = 4) -> DataFrame:
    """One row: rank correlation of the rows where both values are known; ties get average ranks.

    Equal value pairs are counted first, so frequent values do not travel row by row, and the ranks
    come from running totals over the distinct values.
    """
    pairs = materialize(  # read four times below
        df.select(clean_double(left).alias("_x"), clean_double(right).alias("_y"))
        .where("_x is not null and _y is not null")
        .groupBy("_x", "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = pairs.join(_average_ranks(pairs, "_x", "_n", "_rx"), F.col("_x") == F.col("_value")).drop("_value")
    ranked = ranked.join(_average_ranks(pairs, "_y", "_n", "_ry"), F.col("_y") == F.col("_value")).drop("_value")
    # Ranks are centred on (n + 1) / 2, known beforehand, which keeps the sums well conditioned.
    n = pairs.agg(F.sum("_n")).scalar()
    dx, dy = F.col("_rx") - (n + 1) / 2, F.col("_ry") - (n + 1) / 2
    w = F.col("_n")
    return ranked.agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("n"),
        F.sum(w * dx * dy).alias("_xy"),
        F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"),
    ).select(
        F.lit(left).alias("feature1"),
        F.lit(right).alias("feature2"),
        F.round(safe_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))), digits).alias("spearman"),
        "n",
    )


def jarque_bera(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moment test of normality over all rows; columns with fewer than five values are left out."""
    row = df.agg(
        *[
            F.struct(
                F.count(clean_double(c)).alias("n"),
                F.skewness(clean_double(c)).alias("g"),
                F.kurtosis(clean_double(c)).alias("k"),
                sample_skewness(clean_double(c)).alias("skewness"),
                sample_kurtosis(clean_double(c)).alias("kurtosis"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    structs = []
    for i, c in enumerate(columns):
        s = F.col(f"c{i}")
        statistic = s["n"] / 6 * (s["g"] * s["g"] + s["k"] * s["k"] / 4)
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit("Jarque-Bera").alias("test"),
                s["n"].alias("n"),
                statistic.alias("statistic"),
                F.exp(-statistic / 2).alias("p_value"),
                s["skewness"].alias("skewness"),
                s["kurtosis"].alias("kurtosis"),
            )
        )
    return one_row_to_long(row, structs).where(F.col("n") >= 5).withColumn("is_normal", F.col("p_value") > 0.05)


# Royston's 1995 polynomials for the two largest weights and for the p-value (n > 11).
_ROYSTON_LAST = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
_ROYSTON_NEXT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
_ROYSTON_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]
_ROYSTON_LOG_SD = [0.0030302, -0.082676, -0.4803]
# The same for 4 to 11 values, by n itself, with the bound of the transformed statistic.
_ROYSTON_FEW_BOUND = [0.459, -2.273]
_ROYSTON_FEW_MEAN = [-0.0006714, 0.025054, -0.39978, 0.5440]
_ROYSTON_FEW_LOG_SD = [-0.0020322, 0.062767, -0.77857, 1.3822]


def shapiro_wilk(df: DataFrame, column: str) -> DataFrame:
    """Shapiro-Wilk W with Royston's weights over ALL rows, as one row.

    Every row gets its exact rank in the global order; W is then a ratio of plain sums. Three values have an
    exact distribution, and 4 to 11 an approximation of their own. Below three values, and where all are
    equal, statistic, p_value and is_normal are NULL.
    """
    values = df.select(clean_double(column).alias("_x")).where("_x is not null")
    placed = with_position(values, ["_x"])
    n = F.col(SERIES_SIZE).cast("double")
    m = normal_ppf((F.col(POSITION) + 1 - 0.375) / (n + 0.25))
    mean = values.agg(F.avg("_x")).scalar()
    d = F.col("_x") - mean
    sums = placed.agg(
        F.max(n).alias("n"),
        F.sum(m * m).alias("mm"),
        F.sum(m * d).alias("md"),
        F.sum(d * d).alias("dd"),
        F.max(F.when(F.col(POSITION) == n - 1, m)).alias("m1"),
        F.max(F.when(F.col(POSITION) == n - 2, m)).alias("m2"),
        F.max(F.when(F.col(POSITION) == n - 1, d)).alias("dn1"),
        F.max(F.when(F.col(POSITION) == n - 2, d)).alias("dn2"),
        F.max(F.when(F.col(POSITION) == 0, d)).alias("d01"),
        F.max(F.when(F.col(POSITION) == 1, d)).alias("d02"),
    )
    u = 1 / F.sqrt("n")
    # The outermost weight on each side is replaced, from six values on the one next to it as well.
    two = F.when(F.col("n") > 5, 1.0).otherwise(0.0)
    last = polynomial(u, _ROYSTON_LAST) + F.col("m1") / F.sqrt("mm")
    outer, inner = F.col("dn1") - F.col("d01"), F.col("dn2") - F.col("d02")
    weighted = (
        sums.withColumn("a1", F.when(F.col("n") == 3, math.sqrt(0.5)).otherwise(last))
        .withColumn("a2", polynomial(u, _ROYSTON_NEXT) + F.col("m2") / F.sqrt("mm"))
        .withColumn(
            "phi",
            (F.col("mm") - 2 * F.col("m1") ** 2 - two * 2 * F.col("m2") ** 2)
            / (1 - 2 * F.col("a1") ** 2 - two * 2 * F.col("a2") ** 2),
        )
        # Inner weights are m / sqrt(phi).
        .withColumn("rest", (F.col("md") - F.col("m1") * outer - two * F.col("m2") * inner) / F.sqrt("phi"))
        .withColumn(
            "ad", F.when(F.col("n") == 3, 0.0).otherwise(F.col("rest")) + F.col("a1") * outer + two * F.col("a2") * inner
        )
        .withColumn("w", F.when((F.col("n") >= 3) & (F.col("dd") > 0), F.least(F.col("ad") ** 2 / F.col("dd"), F.lit(1.0))))
    )
    w, log_n = F.col("w"), F.log("n")
    left = F.log(1 - w)
    many = (left - polynomial(log_n, _ROYSTON_MEAN)) / F.exp(polynomial(log_n, _ROYSTON_LOG_SD))
    n_ = F.col("n")
    bound = polynomial(n_, _ROYSTON_FEW_BOUND)
    few = (-F.log(bound - left) - polynomial(n_, _ROYSTON_FEW_MEAN)) / F.exp(polynomial(n_, _ROYSTON_FEW_LOG_SD))
    three = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    p_value = (
        F.when(w.isNull(), F.lit(None))
        .when(n_ == 3, three)
        .when(w == 1, 1.0)
        .when((n_ <= 11) & (left >= bound), 0.0)
        .when(n_ <= 11, normal_upper_tail(few))
        .otherwise(normal_upper_tail(many))
    )
    return weighted.select(
        F.lit(column).alias("column"),
        F.lit("Shapiro-Wilk").alias("test"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        w.alias("statistic"),
        p_value.alias("p_value"),
    ).withColumn("is_normal", F.col("p_value") > 0.05)


def _bin_index(column: str, fences: Sequence[float] | None) -> Column:
    """Quantile bin of a numeric column (0-based), or the text of a categorical one."""
    if fences is None:
        return as_text(column)
    x = clean_double(column)
    above = sum((F.when(F.lit(fence) < x, 1).otherwise(0) for fence in fences), F.lit(0))
    return F.when(x.isNotNull(), above.cast("string"))


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """``(feature, mutual_info, n)`` in nats against the target; numeric columns use quantile bins."""
    numeric = [
        f.name
        for f in df.schema.fields
        if f.name in {*features, target} and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    # A handful of fences per numeric column comes back to the driver and enters the scan as literals.
    aggregates = quantile_aggregates(df, numeric, [i / bins for i in range(1, bins)])
    row = df.agg(*aggregates.values()).first() if aggregates else ()
    fences = dict(zip(aggregates, row))
    binned = df.select(
        _bin_index(target, fences.get(target)).alias("_t"),
        *[_bin_index(f, fences.get(f)).alias(f) for f in features],
    ).where("_t is not null")
    cells = materialize(
        binned.unpivot(["_t"], list(features), "feature", "_f")
        .where("_f is not null")
        .groupBy("feature", "_f", "_t")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    by_f = cells.groupBy("feature", "_f").agg(F.sum("_n").alias("_nf"))
    by_t = cells.groupBy("feature", "_t").agg(F.sum("_n").alias("_nt"))
    total = cells.groupBy("feature").agg(F.sum("_n").alias("_all"))
    joined = cells.join(by_f, ["feature", "_f"]).join(by_t, ["feature", "_t"]).join(F.broadcast(total), "feature")
    term = F.col("_n") / F.col("_all") * F.log(F.col("_n") * F.col("_all") / (F.col("_nf") * F.col("_nt")))
    return joined.groupBy("feature").agg(
        F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_info"), F.sum("_n").alias("n")
    )


def contingency(df: DataFrame, row: str, column: str, dense: bool = False) -> DataFrame:
    """``(row_value, col_value, n)``; ``dense`` adds the zero cells."""
    cells = (
        df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col(row).alias("row_value"), F.col(column).alias("col_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not dense:
        return cells
    # The grid is the result asked for: one row per pair of a row value and a column value.
    grid = cells.select("row_value").distinct().join(cells.select("col_value").distinct())
    return grid.join(cells, ["row_value", "col_value"], "left").select(
        "row_value", "col_value", F.coalesce("n", F.lit(0)).alias("n")
    )


def row_shares(df: DataFrame, row: str, column: str, percent: bool = True, digits: int = 4) -> DataFrame:
    """Contingency counts with the share of each cell within its row."""
    cells = contingency(df, row, column)
    totals = cells.groupBy("row_value").agg(F.sum("n").alias("_total"))
    scale = 100 if percent else 1
    return cells.join(totals, "row_value").select(
        "row_value", "col_value", "n", F.round(F.col("n") * scale / F.col("_total"), digits).alias("share")
    )


def pairwise_contingency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column1, value1, column2, value2, n)`` for every pair of columns in one aggregation."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("column1"), as_text(a).alias("value1"), F.lit(b).alias("column2"), as_text(b).alias("value2")
            )
            for a, b in combinations(columns, 2)
        ]
    )
    return (
        df.select(F.inline(pairs))
        .where("value1 is not null and value2 is not null")
        .groupBy("column1", "value1", "column2", "value2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def joint_frequency(df: DataFrame, columns: Sequence[str], margins: bool = False) -> DataFrame:
    """Row count of each combination of the text columns; ``margins`` adds every subtotal."""
    used = list(columns)
    texts = df.select(*[F.coalesce(as_text(c), F.lit("nan")).alias(c) for c in used])
    if not margins:
        return texts.groupBy(*used).agg(F.count(F.lit(1)).alias("n"))
    return texts.cube(*used).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("margin_level"))
