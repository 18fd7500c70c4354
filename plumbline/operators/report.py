"""Results of many analyses as one tidy table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

REPORT_COLUMNS = ("section", "subject", "metric", "value_num", "value_str")


def run_metadata(df: DataFrame, source: str, with_time: bool = True) -> DataFrame:
    """One row: source, rows, columns and the time of the run."""
    row = df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(source).alias("source"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
    )
    return row.withColumn("analysed_at", F.current_timestamp()) if with_time else row


def as_facts(section: str, result: DataFrame, subject: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Melt a result: one row per result row and metric, numbers and texts in separate columns."""
    label = F.concat_ws("/", *[F.col(c).cast("string") for c in subject]) if subject else F.lit("table")
    cells: list[Column] = []
    for field in result.schema.fields:
        if field.name in subject:
            continue
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            number = F.col(field.name).cast("double")
            number = number if digits is None else F.round(number, digits)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.col(field.name))
        else:
            text = F.col(field.name).cast("string")
        cells.append(
            F.struct(F.lit(field.name).alias("metric"), number.alias("value_num"), text.alias("value_str"))
        )
    return result.select(F.lit(section).alias("section"), label.alias("subject"), F.inline(F.array(*cells)))


def report_table(facts: Sequence[DataFrame]) -> DataFrame:
    """Union of melted results."""
    table = facts[0]
    for part in facts[1:]:
        table = table.unionByName(part)
    return table.select(*REPORT_COLUMNS)
