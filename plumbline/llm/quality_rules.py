"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once per document and stores the measurements and one bit per failed
rule. A policy is a named, versioned set of rules; ``apply_policy`` needs only the stored bits, and
``ablations`` tells, for every rule of a policy, what it alone is responsible for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import let, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements (fields of a struct) holds."""

    name: str
    fails: Callable[[Column], Column]


# The position of a rule is its bit; new rules go to the end so that stored ledgers keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("upper_case", lambda m: 2 * m["n_upper"] > m["n_letters"]),
    Rule("shouting", lambda m: 100 * m["n_shouts"] > 30 * m["n_words"]),
    Rule("stutter", lambda m: 100 * m["n_stutters"] > 20 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("no_letters", lambda m: m["n_letters"] == 0),
)

BASE = ("too_few_words", "repeated_windows")
POLICIES: Mapping[str, Sequence[str]] = {
    "base-v1": BASE,
    "web-v1": (*BASE, "symbols", "upper_case", "shouting", "stutter", "no_letters"),
    "strict-v1": tuple(rule.name for rule in RULES),
}


def policy_mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    places = {rule.name: place for place, rule in enumerate(rules)}
    return sum(1 << places[name] for name in set(names))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of ``WINDOW`` words that occurs twice or more in ``words``.

    Windows are compared by 64-bit hashes. Only where a plain sort of the hashes shows an equal pair
    are they sorted together with their places.
    """
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(
                (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")
            ),
            lambda a: a["n"],
        )

    def repeated_places(pairs: Column) -> Column:
        def place(pair: Column, j: Column) -> Column:
            before = (j > 0) & (F.get(pairs, j - 1)["h"] == pair["h"])
            after = F.get(pairs, j + 1)["h"] == pair["h"]
            return F.when(before | F.coalesce(after, F.lit(False)), pair["i"])

        return F.sort_array(F.array_compact(F.transform(pairs, place)))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            covered(let(pairs, repeated_places))
        )

    return let(hashes, count)


def measured(text: Column) -> Column:
    """Struct of the measurements of a text that isn't NULL; words, lines and letters are taken once."""

    def counts(words: Column, lines: Column, letters: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")),
            "n_symbols": F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_lines": F.size(lines),
            "n_letters": F.length(letters),
            "n_upper": F.length(letters) - F.length(F.regexp_replace(letters, "\\p{Lu}+", "")),
            "n_shouts": F.regexp_count(text, F.lit("!!+")),
            "n_stutters": F.size(F.filter(words, lambda w, i: (i > 0) & (F.get(words, i - 1) == w))),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in values.items()])

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    letters = F.regexp_replace(text, "\\P{L}+", "")
    return let(words_of(text), lambda w: let(lines, lambda x: let(letters, lambda c: counts(w, x, c))))


def judged(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct of the measurements and ``failed``, a long with bit k set where rule k fails.

    One expression that evaluates every rule once, so a filter on it can be moved without repeating work.
    """

    def bits(m: Column) -> Column:
        failed = F.lit(0).cast("long")
        for place, rule in enumerate(rules):
            failed = failed.bitwiseOR(F.when(rule.fails(m), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
        return F.struct(m.alias("measured"), failed.alias("failed"))

    return let(measured(text), bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: the id, all measurements and ``failed``.

    NULL text counts as empty: no words, no lines, all counts 0. Repeated ids are separate rows.
    """
    found = docs.select(F.col(id_col), judged(text_or_empty(text_col), rules).alias("_judged"))
    return found.select(id_col, "_judged.measured.*", "_judged.failed")


def apply_policy(rows: DataFrame, policy: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``kept`` and the policy's name to ledger rows; the texts are not needed again."""
    mask = policy_mask(POLICIES[policy], rules)
    return rows.withColumns({"policy": F.lit(policy), "kept": F.col("failed").bitwiseAND(mask) == 0})


def ablations(rows: DataFrame, policy: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule of a policy: how many rows fail it, fail only it, and are kept without it.

    Equal bit patterns are counted first, so what is regrouped is at most one row per pattern.
    """
    names = [rule.name for rule in rules if rule.name in POLICIES[policy]]
    mask = policy_mask(names, rules)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(policy_mask([n], rules)).alias("bit")) for n in names])
    spread = patterns.select("bits", "n", F.inline(each))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(mask) - F.col("bit")) == 0
    return spread.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(hit & rest, F.col("n"))), F.lit(0)).alias("n_only_this"),
        F.coalesce(F.sum(F.when(rest, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def kept_documents(docs: DataFrame, policy: str = "web-v1", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with the columns of ``docs`` and nothing else."""
    mask = policy_mask(POLICIES[policy], rules)
    return docs.where(judged(text_or_empty(text_col), rules)["failed"].bitwiseAND(mask) == 0)
