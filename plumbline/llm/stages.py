"""The stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

Each works on all rows it is given, tells nothing from ``doc_id`` but which of several copies stays, and
keeps columns it does not know, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import bpe, decontaminate, near_copies, pii, quality_rules as rules
from plumbline.llm.common import bound_batches
from plumbline.llm.queries import PSEUDONYM_KEY, WORD_TOKENIZER, table, tokenizer_path

# Spark hides the values of settings whose names hold "secret" in its logs and pages.
KEY_SETTING = "spark.plumbline.pseudonym.secret"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy ``web-v1`` keeps; NULL, empty and blank texts have too few words and go."""
    return rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those that five-word shingles with a similarity of 0.8 or more link.

    It is the one with the smallest id, known ids first. NULL texts count as empty ones, which are copies
    of each other; of rows that agree in id and text one stays.
    """
    bound_batches(spark)
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item, be its id known or not; NULL texts hold none and stay."""
    bound_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts exchanged for pseudonyms; NULL texts stay NULL.

    The key is the session's setting ``KEY_SETTING``; only where it is unset, as in tests, it is the key of the
    test queries.
    """
    bound_batches(spark)
    key = spark.conf.get(KEY_SETTING, None)
    return pii.pseudonymized_documents(docs, key.encode() if key else PSEUDONYM_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, n_tokens and decoded, which replace columns of these names.

    NULL and empty texts have no tokens and decode to the empty text.
    """
    bound_batches(spark)
    tokenizer = bpe.read_tokenizer(spark, tokenizer_path(WORD_TOKENIZER))
    kept = [c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens", "decoded")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    coded = docs.select(row, bpe.recoded(F.col("text"), tokenizer).alias("coded"))
    ids = F.col("coded.ids")
    return coded.select(
        *[F.col("row")[c].alias(c) for c in kept],
        ids.alias("token_ids"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.col("coded.decoded").alias("decoded"),
    )
