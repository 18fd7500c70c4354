"""Folder watch: every new file is analysed once, with one result set per micro-batch.

The streaming file source notices new files only; ``poll_folder`` compares modification times and so
sees changed files as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.quality import _missing
from plumbline.operators.schema import classify
from plumbline.functions.quantiles import clean_double

FILE = "_file"


def file_profile(batch: DataFrame) -> DataFrame:
    """``(file, column, dtype, rows, missing, mean)`` of every file in a batch, in one aggregation."""
    columns = [c for c in batch.columns if c != FILE]
    numeric = set(classify(batch.select(*columns), parse_text=False).numeric)
    dtypes = dict(batch.dtypes)
    facts = batch.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_missing(batch, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.avg(clean_double(c)).alias(f"a{i}") for i, c in enumerate(columns) if c in numeric],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(dtypes[c]).alias("dtype"),
            F.col("rows"),
            F.col(f"m{i}").alias("missing"),
            (F.col(f"a{i}") if c in numeric else F.lit(None).cast("double")).alias("mean"),
        )
        for i, c in enumerate(columns)
    ]
    return facts.select(F.col(FILE).alias("file"), F.inline(F.array(*cells)))


def watch_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    results: str,
    checkpoint: str,
    file_format: str = "csv",
    pattern: str | None = None,
    analyse: Callable[[DataFrame], DataFrame] = file_profile,
    once: bool = True,
) -> StreamingQuery:
    """Start the watch; results land in ``results/batch=<id>``, so a repeated batch replaces itself.

    ``once`` handles everything present and stops, otherwise the query keeps polling the folder.
    """
    source = spark.readStream.schema(schema).format(file_format)
    if file_format == "csv":
        source = source.option("header", True)
    if pattern:
        source = source.option("pathGlobFilter", pattern)
    rows = source.load(folder).withColumn(FILE, F.col("_metadata.file_path"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = analyse(batch).withColumn("analysed_at", F.current_timestamp())
        found.write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def poll_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    results: str,
    state: str,
    file_format: str = "csv",
    pattern: str | None = None,
    analyse: Callable[[DataFrame], DataFrame] = file_profile,
) -> DataFrame:
    """One look at the folder: files that are new or were modified since their last analysis are analysed.

    Results are appended with their ``poll``; ``state`` keeps path and modification time of what is done
    and is written last, so an interrupted poll is repeated. Returns the files handled. The contents of
    files that did not change are not read; the list of changed paths comes to the driver, as any file
    listing does.
    """
    listing = spark.read.format("binaryFile")
    listing = listing.option("pathGlobFilter", pattern) if pattern else listing
    files = listing.load(folder).select("path", F.col("modificationTime").alias("modified"))
    empty = spark.createDataFrame([], "path string, modified timestamp")
    try:
        seen = spark.read.schema(empty.schema).parquet(state)
        seen.limit(1).collect()
    except AnalysisException:  # the first poll
        seen = empty
    last = seen.groupBy("path").agg(F.max("modified").alias("known"))
    due = files.join(last, "path", "left").where(F.col("known").isNull() | (F.col("modified") > F.col("known")))
    handled = [(r["path"], r["modified"]) for r in due.collect()]
    changed = spark.createDataFrame(handled, empty.schema)
    if handled:
        reader = spark.read.schema(schema).format(file_format)
        reader = reader.option("header", True) if file_format == "csv" else reader
        rows = reader.load([path for path, _ in handled]).withColumn(FILE, F.col("_metadata.file_path"))
        found = analyse(rows).withColumns({"poll": F.lit(uuid.uuid4().hex), "analysed_at": F.current_timestamp()})
        found.write.mode("append").parquet(results)
        changed.write.mode("append").parquet(state)
    return changed
