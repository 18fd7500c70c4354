"""Table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.operators.clean import first_seen_codes, label_codes


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with header; timestamps keep their microseconds."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_encoding_maps(
    df: DataFrame, columns: Sequence[str], path: str, method: str = "label", order_by: Sequence[str] = ()
) -> DataFrame:
    """Persist ``(column, value, code)`` partitioned by column and return the stored table."""
    codes = label_codes(df, columns) if method == "label" else first_seen_codes(df, columns, order_by)
    write_parquet(codes, path, ["column"])
    return df.sparkSession.read.parquet(path)
