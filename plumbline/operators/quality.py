"""Missing values, duplicate rows and the quality score built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.statistics import safe_divide
from plumbline.operators.schema import one_row_to_long


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    dtype = dict(df.dtypes)[name]
    return column.isNull() | F.isnan(column) if dtype in ("float", "double") else column.isNull()


def missing_counts_row(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and one count ``m<i>`` of missing values per column."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )


def missing_summary(df: DataFrame, digits: int = 2) -> DataFrame:
    """``(column, missing, missing_pct)`` from one scan."""
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"m{i}").alias("missing"),
            F.round(safe_divide(F.col(f"m{i}") * 100, F.col("rows")), digits).alias("missing_pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    return one_row_to_long(missing_counts_row(df), structs)


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: rows, columns, all missing cells and their share of all cells."""
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    return missing_counts_row(df).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        total.cast("long").alias("missing"),
        F.round(safe_divide(total * 100, F.col("rows") * len(df.columns)), 2).alias("missing_pct"),
    )


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: rows that repeat an earlier row in all columns (NULLs are equal)."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    ).withColumn("duplicate_pct", F.round(safe_divide(F.col("duplicates") * 100, F.col("rows")), 2))


def quality_score(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness and their mean, each out of 100."""
    totals = missing_totals(df)
    copies = duplicate_summary(df).agg(F.first(F.struct("duplicates", "rows"))).scalar()
    cells = F.col("rows") * F.col("columns")
    completeness = 100 - safe_divide(F.col("missing") * 100, cells)
    uniqueness = 100 - safe_divide(copies["duplicates"] * 100, F.col("rows"))
    return totals.select(
        "rows",
        "columns",
        F.round(completeness, 4).alias("completeness_score"),
        F.round(uniqueness, 4).alias("uniqueness_score"),
        F.round((completeness + uniqueness) / 2, 4).alias("quality_score"),
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """One row per column with missing values and one for duplicate rows, with advice."""
    missing = missing_summary(df, digits=4).where("missing > 0").select(
        F.lit("missing_values").alias("issue_type"),
        "column",
        F.col("missing").alias("count"),
        F.col("missing_pct").alias("percentage"),
        F.lit("May affect analysis accuracy").alias("impact"),
        F.lit("Consider imputation or filtering").alias("recommendation"),
    )
    share = F.round(safe_divide(F.col("duplicates") * 100, F.col("rows")), 4)
    copies = duplicate_summary(df).where("duplicates > 0").select(
        F.lit("duplicate_rows").alias("issue_type"),
        F.lit(None).cast("string").alias("column"),
        F.col("duplicates").alias("count"),
        share.alias("percentage"),
        F.lit("May skew analysis results").alias("impact"),
        F.lit("Remove duplicates before analysis").alias("recommendation"),
    )
    return missing.unionByName(copies)
