"""Table readers chosen by file extension."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, types as T

from plumbline.sources.workbooks import read_workbooks


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, quoted_lines: bool = True
) -> DataFrame:
    """CSV with header; give a schema for big data, since type inference reads the files twice.

    A quoted field may hold line ends, so a file is read by one task; large exports come as many files.
    ``quoted_lines=False`` promises that there are none, and lets single large files be split.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", quoted_lines)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, records: bool = True
) -> DataFrame:
    """JSON; ``records`` reads one array of objects per file, otherwise one object per line (splittable)."""
    reader = spark.read.option("multiLine", records)
    return (reader.schema(schema) if schema is not None else reader).json(path)


_READERS = {
    ".csv": read_csv,
    ".json": read_json,
    ".jsonl": lambda spark, path, schema=None: read_json(spark, path, schema, records=False),
    ".xlsx": read_workbooks,
    ".parquet": lambda spark, path, schema=None: spark.read.parquet(path),
    ".orc": lambda spark, path, schema=None: spark.read.orc(path),
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a file, folder or glob by its lower-cased extension; unknown ones are an error."""
    extension = posixpath.splitext(path.rstrip("/"))[1].lower()
    if extension not in _READERS:
        raise ValueError(f"unsupported file format: {extension or path}")
    return _READERS[extension](spark, path, schema)
