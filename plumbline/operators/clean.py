"""Cleaning: duplicates, missing values, encodings and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.ordered import POSITION, fill_forward_backward, null_safe_join, with_position
from plumbline.functions.quantiles import clean_double, column_statistics, number, quantile_aggregates
from plumbline.functions.scratch import materialize
from plumbline.functions.statistics import safe_divide
from plumbline.operators.quality import missing_counts_row
from plumbline.operators.schema import as_text, distinct_counts, long_values, value_counts


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def sparse_columns(df: DataFrame, threshold: float = 0.3) -> list[str]:
    """Names of the columns whose share of missing values is strictly above ``threshold``."""
    row = missing_counts_row(df).first()
    return [c for i, c in enumerate(df.columns) if row["rows"] and row[f"m{i}"] / row["rows"] > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill numeric columns with their exact median (as double)."""
    medians = quantile_aggregates(df, columns, [0.5])
    return df.withColumns({c: F.coalesce(clean_double(c), medians[c][0]) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill numeric columns with their mean (as double)."""
    if not columns:
        return df
    (means,) = column_statistics(df, columns, F.avg)
    return df.withColumns({c: F.coalesce(clean_double(c), number(m)) for c, m in zip(columns, means)})


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)``: the most frequent value, the smallest one on a tie."""
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    return value_counts(df, columns).groupBy("column").agg(best.alias("b")).select("column", "b.value", "b.n")


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill text columns with their most frequent value; an all-null column stays null."""
    if not columns:
        return df
    modes = {r["column"]: r["value"] for r in column_modes(df, columns).collect()}  # one row per column
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(modes.get(c))) for c in columns})


def impute_dates(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Fill dates forward, then backward, in the given row order."""
    return fill_forward_backward(df, columns, order_by, keys) if columns else df


def label_codes(df: DataFrame, columns: Sequence[str], null_label: str | None = None) -> DataFrame:
    """``(column, value, code)``: codes 0.. in sorted order of the text value, per column."""
    source = df
    if null_label is not None:
        source = df.select(*[F.coalesce(as_text(c), F.lit(null_label)).alias(c) for c in columns])
    return _coded(long_values(source, columns).distinct(), ["value"])


def first_seen_codes(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: codes 0.. in order of first appearance, per column."""
    order = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    staged = df.select(order.alias("_seen"), *[as_text(c).alias(c) for c in columns])
    first = (
        staged.unpivot(["_seen"], list(columns), "column", "value")
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.min("_seen").alias("_seen"))
    )
    return _coded(first, ["_seen", "value"])


def _coded(values: DataFrame, order_by: list[str]) -> DataFrame:
    return with_position(values, order_by, ["column"]).select("column", "value", F.col(POSITION).alias("code"))


def encode(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "label",
    order_by: Sequence[str] = (),
    null_label: str | None = None,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Add ``<column>_encoded``; ``method`` is ``label`` (sorted) or ``first_seen`` (needs ``order_by``)."""
    if method not in ("label", "first_seen"):
        raise ValueError(f"unknown encoding method {method!r}")
    if not columns:
        return df
    if codes is None:
        codes = label_codes(df, columns, null_label) if method == "label" else first_seen_codes(df, columns, order_by)
    codes = materialize(codes)  # read once per column; its size then decides how it is joined
    result = df
    for c in columns:
        table = codes.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias(f"{c}_encoded")
        )
        key = as_text(c) if null_label is None else F.coalesce(as_text(c), F.lit(null_label))
        result = result.withColumn("_key", key).join(table, F.col("_key") == F.col("_value"), "left")
        result = result.drop("_key", "_value")
    return result


def category_lists(df: DataFrame, columns: Sequence[str], max_categories: int | None) -> dict[str, list[str]]:
    """Sorted values of every column, or of those with at most ``max_categories``."""
    small = list(columns)
    if max_categories is not None:
        few = distinct_counts(df, columns).where(F.col("distinct_values") <= max_categories)
        small = [r["column"] for r in few.collect()]
    found: dict[str, list[str]] = {c: [] for c in columns if c in small}
    for row in long_values(df, small).distinct().collect() if small else []:
        found[row["column"]].append(row["value"])
    return {c: sorted(values) for c, values in found.items()}


def one_hot_columns(df: DataFrame, columns: Sequence[str], max_categories: int | None = None) -> DataFrame:
    """Add 0/1 columns ``<column>_<value>``: a schema of its own width, so the driver lists the values.

    ``max_categories`` leaves wider columns out; for those :func:`one_hot_vectors` has sparse vectors.
    """
    lists = category_lists(df, columns, max_categories)
    dummies: dict[str, Column] = {
        f"{c}_{v}": F.when(as_text(c) == v, 1).otherwise(0) for c, values in lists.items() for v in values
    }
    return df.withColumns(dummies) if dummies else df


def one_hot_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add sparse vectors ``<column>_onehot`` for columns with any number of categories.

    The codes come from the distributed code table; only the number of categories reaches the driver.
    A missing value has the last place.
    """
    codes = label_codes(df, columns)
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    encoded = encode(df, columns, "label", codes=codes)
    for c in columns:
        place = F.coalesce(F.col(f"{c}_encoded"), F.lit(sizes.get(c, 0))).cast("double")
        width = {"ml_attr": {"type": "nominal", "num_vals": sizes.get(c, 0) + 1, "name": f"{c}_index"}}
        encoded = encoded.withColumn(f"{c}_index", place).withMetadata(f"{c}_index", width)
    result = encoded.drop(*[f"{c}_encoded" for c in columns])
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=False
    )
    return encoder.fit(result).transform(result).drop(*[f"{c}_index" for c in columns])


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Add ``(x - mean) / population std``; a constant column becomes 0."""
    means, spreads = column_statistics(df, columns, F.avg, F.stddev_pop)

    def scaled(c: str, mean: float | None, spread: float | None) -> Column:
        centred = clean_double(c) - number(mean)
        return centred * 0 if spread == 0 else centred / number(spread)

    return df.withColumns({f"{c}{suffix}": scaled(c, m, s) for c, m, s in zip(columns, means, spreads)})


def cleaning_summary(before: DataFrame, after: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """``(step, subject, value)``: rows, duplicates, missing cells, dropped and encoded columns."""
    kept = set(after.columns)

    def totals(df: DataFrame, tag: str) -> DataFrame:
        missing = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0)).cast("long")
        return missing_counts_row(df).select(F.lit(tag).alias("tag"), "rows", missing.alias("missing"))

    both = totals(before, "before").unionByName(totals(after, "after")).groupBy().agg(
        F.max_by("rows", F.col("tag") == "before").alias("rows_before"),
        F.max_by("rows", F.col("tag") == "after").alias("rows_after"),
        F.max_by("missing", F.col("tag") == "before").alias("missing_before"),
        F.max_by("missing", F.col("tag") == "after").alias("missing_after"),
    )

    def item(step: str, value: Column) -> Column:
        subject = F.lit(None).cast("string").alias("subject")
        return F.struct(F.lit(step).alias("step"), subject, value.cast("double").alias("value"))

    facts = both.select(
        F.inline(
            F.array(
                item("rows_before", F.col("rows_before")),
                item("rows_after", F.col("rows_after")),
                item("duplicates_removed", F.col("rows_before") - F.col("rows_after")),
                item(
                    "duplicate_pct",
                    F.round(safe_divide((F.col("rows_before") - F.col("rows_after")) * 100, F.col("rows_before")), 2),
                ),
                item("missing_before", F.col("missing_before")),
                item("missing_after", F.col("missing_after")),
                item("missing_imputed", F.col("missing_before") - F.col("missing_after")),
            )
        )
    )
    gone = [c for c in before.columns if c not in kept]
    row = missing_counts_row(before)
    for c in gone:
        share = F.round(safe_divide(F.col(f"m{before.columns.index(c)}") * 100, F.col("rows")), 2)
        facts = facts.unionByName(
            row.select(F.lit("dropped_column").alias("step"), F.lit(c).alias("subject"), share.alias("value"))
        )
    encoded = [c for c in categorical if c in kept and f"{c}_encoded" in kept]
    if encoded:
        facts = facts.unionByName(
            distinct_counts(after, encoded).select(
                F.lit("encoded_column").alias("step"),
                F.col("column").alias("subject"),
                F.col("distinct_values").cast("double").alias("value"),
            )
        )
    return facts


def clean(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    datetime: Sequence[str],
    order_by: Sequence[str],
    missing_threshold: float = 0.3,
    encoding: str | None = "label",
) -> DataFrame:
    """Duplicates, sparse columns, imputation and encoding in the fixed order of the cleaning step.

    Only columns that miss values are imputed, so complete dates cost no global ordering.
    """
    rows = drop_duplicate_rows(df)
    counts = missing_counts_row(rows).first()
    missing = {c: counts[f"m{i}"] for i, c in enumerate(rows.columns)}
    gone = {c for c, m in missing.items() if counts["rows"] and m / counts["rows"] > missing_threshold}
    rows = rows.drop(*gone)
    keep = lambda names: [c for c in names if c not in gone]
    holes = lambda names: [c for c in keep(names) if missing[c]]
    rows = impute_dates(rows, holes(datetime), keep(order_by))
    rows = impute_mode(impute_median(rows, holes(numeric)), holes(categorical))
    if encoding:
        rows = encode(rows, keep(categorical), encoding, keep(order_by))
    return rows


