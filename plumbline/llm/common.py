"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The blanks of the word definition [^\x20\x09-\x0D]+, as characters and as a regular expression.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
# Texts reach Python in batches of about this many bytes, however long single texts are.
ARROW_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that this session hands to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def text_or_empty(name: str) -> Column:
    """The text column, with the empty string for NULL."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_share(name: str, modulus: int) -> Column:
    """crc32 of a column's text modulo ``modulus``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of non-blank characters, in order; an empty array for a text without any."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
