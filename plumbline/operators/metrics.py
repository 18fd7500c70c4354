"""Model quality from tables of labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.ordered import null_safe_join, running_totals
from plumbline.functions.scratch import materialize
from plumbline.functions.statistics import safe_divide


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, mse, rmse, mape, mae, r2)``; rows with a zero label do not enter the percentage error."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    return df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(safe_divide(e, y))) * 100).alias("mape"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - safe_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, actual, predicted, n)`` for every pair of classes, zero cells included."""
    cells = df.groupBy(*keys, F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = cells.select(F.inline(F.array(F.struct(F.col("actual").alias("c")), F.struct(F.col("predicted").alias("c")))))
    # The grid is the result asked for: every class with every class, for every key.
    names = classes.distinct()
    grid = names.withColumnRenamed("c", "actual").join(names.withColumnRenamed("c", "predicted"))
    if keys:
        grid = cells.select(*keys).distinct().join(grid)
    return null_safe_join(grid, cells, [*keys, "actual", "predicted"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def classification_metrics(
    df: DataFrame, label: str, prediction: str, keys: Sequence[str] = (), binary: bool = False
) -> DataFrame:
    """``(keys, accuracy, precision, recall, f1)`` from the counts of (label, prediction).

    Weighted by class size, or for the larger label alone when ``binary``. Undefined ratios are 0.
    """
    cells = df.groupBy(*keys, F.col(label).alias("_a"), F.col(prediction).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sides = F.array(
        F.struct(
            F.col("_a").alias("_c"),
            F.when(F.col("_a") == F.col("_p"), F.col("_n")).otherwise(0).alias("_hit"),
            F.col("_n").alias("_actual"),
            F.lit(0).cast("long").alias("_predicted"),
        ),
        F.struct(
            F.col("_p").alias("_c"),
            F.lit(0).cast("long").alias("_hit"),
            F.lit(0).cast("long").alias("_actual"),
            F.col("_n").alias("_predicted"),
        ),
    )
    per_class = (
        cells.select(*keys, F.inline(sides))
        .groupBy(*keys, "_c")
        .agg(F.sum("_hit").alias("_hit"), F.sum("_actual").alias("_actual"), F.sum("_predicted").alias("_predicted"))
        .withColumn("_pr", F.coalesce(safe_divide(F.col("_hit"), F.col("_predicted")), F.lit(0.0)))
        .withColumn("_re", F.coalesce(safe_divide(F.col("_hit"), F.col("_actual")), F.lit(0.0)))
        .withColumn(
            "_f1",
            F.coalesce(safe_divide(2 * F.col("_pr") * F.col("_re"), F.col("_pr") + F.col("_re")), F.lit(0.0)),
        )
    )
    total = F.sum("_actual")
    if binary:
        value = lambda c: F.max_by(c, "_c")
    else:
        value = lambda c: safe_divide(F.sum(F.col(c) * F.col("_actual")), total)
    return per_class.groupBy(*keys).agg(
        safe_divide(F.sum("_hit"), total).alias("accuracy"),
        value("_pr").alias("precision"),
        value("_re").alias("recall"),
        value("_f1").alias("f1"),
    )


def roc_curve(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """``(threshold, fpr, tpr, area)``: one point per distinct score, highest first.

    Rows are counted per score before they are ordered; ``area`` is the trapezoid up to the point.
    """
    hit = (F.col(label) == F.lit(positive)).cast("long")
    counted = materialize(  # so that the scored rows are read once
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.sum(hit).alias("_pos"), F.sum(1 - hit).alias("_neg"))
    )
    all_rows = counted.agg(F.struct(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))).scalar()
    upto = running_totals(counted, {"_tp": "_pos", "_fp": "_neg"}, [F.desc("threshold")])
    width = safe_divide(F.col("_neg"), all_rows["n"])
    height = safe_divide(2 * F.col("_tp") - F.col("_pos"), 2 * all_rows["p"])
    return upto.select(
        "threshold",
        safe_divide(F.col("_fp"), all_rows["n"]).alias("fpr"),
        safe_divide(F.col("_tp"), all_rows["p"]).alias("tpr"),
        (width * height).alias("area"),
    )


def auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """One row: area under the ROC curve."""
    return roc_curve(df, label, score, positive).agg(F.sum("area").alias("auc"), F.count(F.lit(1)).alias("thresholds"))
