"""The registered queries of the operators in this folder: whole tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm import (
    bpe,
    chat,
    crf_quality,
    decontaminate,
    filter_audit,
    hmm,
    main_text,
    periods,
    pii,
    quality_rules,
    secret_scan,
    simhash,
    token_counts,
)
from plumbline.llm.common import bound_batches, hash_share, let, words_of
from plumbline.llm.oracles import ORACLES
from plumbline.session import apply_runtime_conf

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
MOST_TOKENS = 512
# The key of the test queries; whoever runs the operator brings a secret of their own.
PSEUDONYM_KEY = b"plumbline test key"

__all__ = ["ORACLES", "QUERIES", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    apply_runtime_conf(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return crf_quality.classify(docs, labels, hash_share("doc_id", 5) == 0)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    spans, base = F.col("spans"), len(secret_scan.BASE_RULES)

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in secret_scan.BASE_RULES]
    base_spans = secret_scan.written(F.filter(spans, lambda s: s["rank"] < base))
    return found.select(
        "doc_id", *counts, digest(base_spans).alias("base_sha256"), secret_scan.written(spans).alias("spans")
    )


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op4_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    tokenizer = bpe.read_tokenizer(spark, tokenizer_path(WORD_TOKENIZER))
    return chat.read_back(chat.windows(rows.unionByName(probe), tokenizer))


def op5_hmm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score(table(spark, folder, "documents"), hash_share("doc_id", 7) == 2)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, folder, "documents")), "web-v1")
    base = quality_rules.policy_mask(quality_rules.BASE)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"),
        "kept",
        "failed",
    )


def op7_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.read_tokenizer(spark, tokenizer_path(WORD_TOKENIZER))
    coded = bpe.recoded(F.col("text"), tokenizer)
    docs = table(spark, folder, "documents").select("doc_id", coded.alias("coded"))
    ids = F.col("coded.ids")
    return docs.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        digest(F.array_join(ids.cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("coded.decoded")).alias("decoded_sha256"),
    )



def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract_pages(table(spark, folder, "pages"))


def op9_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    changed = pii.pseudonymized(F.col("text"), PSEUDONYM_KEY)
    docs = table(spark, folder, "documents").select("doc_id", changed.alias("new"))
    return docs.select("doc_id", "new.*")


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.read_tokenizer(spark, tokenizer_path(BYTE_TOKENIZER))
    counts = token_counts.token_counts(table(spark, folder, "documents"), tokenizer)
    return counts.withColumn("over_limit", F.col("n_tokens") > MOST_TOKENS)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, with a periodic end for one id in ten; a NULL id has no decimal form, so its text stays."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        begin = (g % n).cast("int")
        period = (1 + F.floor((n - begin) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < begin, i).otherwise(begin + (i - begin) % period)
        new = F.transform(words, lambda _, i: F.get(words, place(i)))
        return F.when(n > 0, F.array_join(new, " ")).otherwise("")

    return F.when(h % 10 == 0, let(words_of(text), planted)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    text = with_planted_runs(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = periods.periodic_runs(table(spark, folder, "documents").select("doc_id", text.alias("text")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period")))
    return found.withColumn("r", F.array_min(order)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("r.start").alias("start"),
        (-F.col("r.size")).alias("length"),
        F.col("r.period").alias("period"),
        F.floor(-1000 * F.col("r.size") / F.col("r.period")).alias("exponent_milli"),
        digest(periods.long_form(F.col("runs"))).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_quality": op1_crf_quality,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontamination": op3_decontamination,
    "op4_chat_windows": op4_chat_windows,
    "op5_hmm_scores": op5_hmm_scores,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe_encoding": op7_bpe_encoding,
    "op8_main_text": op8_main_text,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
