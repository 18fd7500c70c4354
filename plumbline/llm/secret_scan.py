"""Secret scans through a trigram inverted index, in DataFrame functions only.

From every rule's regular expression a Boolean query over trigrams of the lower-cased text is derived:
an OR of trigram sets, each of which a match needs whole. The index holds, per trigram that any query
names, the sorted keys of the texts that contain it, in buckets of bounded expected size. A bucket
answers a query by intersecting its postings and uniting the branches; only these candidates are run
through the rule's expression. Rules without a mandatory trigram are run over every text.
"""

from __future__ import annotations

import re._parser as parser  # the tree of a parsed expression
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scratch import scratch_path
from plumbline.llm.common import let, text_or_empty

# Expected texts of an index bucket; the number of buckets follows the number of rows.
BUCKET_ROWS = 4096
MAX_STRINGS = 64
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The order of the kinds breaks ties between spans that start together.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z]{2,12}://[^/:@\x09-\x0D\x20]+:[^/:@\x09-\x0D\x20]+@"),
)
RULES = (*BASE_RULES, *ADDED_RULES)

Query = frozenset[frozenset[str]]


def trigram_query(pattern: str) -> Query:
    """OR of trigram sets that every match of ``pattern`` contains; empty if nothing is mandatory."""
    runs = [run for run in _runs(parser.parse(pattern)) if all(len(s) >= 3 for s in run)]
    query: Query = frozenset({frozenset()})
    for run in runs:
        branches = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
        query = frozenset(a | b for a, b in product(query, branches))
    query = frozenset(a for a in query if not any(b < a for b in query))
    return query if all(query) else frozenset()


def _runs(tree) -> list[set[str]]:
    """Stretches of the expression that spell one of a few strings, in order."""
    done: list[set[str]] = []
    current = {""}
    for item in tree:
        strings, complete = _spelled(item)
        longer = {a + b for a, b in product(current, strings)} if strings is not None else None
        if longer is None or len(longer) > MAX_STRINGS:
            done.append(current)
            current = strings if strings is not None and len(strings) <= MAX_STRINGS else {""}
        else:
            current = longer
        if not complete:
            done.append(current)
            current = {""}
    return [*done, current]


def _spelled(item) -> tuple[set[str] | None, bool]:
    """Strings that an element can spell (None: too many), and whether these are all of it."""
    name, value = str(item[0]), item[1]
    if name == "LITERAL":
        return {chr(value)}, True
    if name == "SUBPATTERN":
        parts = _runs(value[3])
        return (parts[0], True) if len(parts) == 1 else (None, False)
    if name == "BRANCH":
        each = [_runs(branch) for branch in value[1]]
        return (set().union(*(e[0] for e in each)), True) if all(len(e) == 1 for e in each) else (None, False)
    if name == "IN" and all(str(kind) == "LITERAL" for kind, _ in value) and len(value) <= 8:
        return {chr(c) for _, c in value}, True
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = value
        parts = _runs(body)
        if len(parts) == 1 and most == 1:
            return parts[0] | ({""} if least == 0 else set()), True
        if len(parts) == 1 and 1 <= least <= 8:
            return reduce(lambda a, b: {x + y for x, y in product(a, b)} if len(a) <= MAX_STRINGS else a, [parts[0]] * least), False
    return None, False


def text_key(text: Column) -> Column:
    """The key of a text in the index. Texts that share a key are candidates together: nothing is lost."""
    return F.xxhash64(text)


def trigram_index(docs: DataFrame, trigrams: Sequence[str], text_col: str = "text") -> DataFrame:
    """``(bucket, trigram, keys)``: postings of the wanted trigrams, equal texts once."""
    buckets = max(1, docs.count() // BUCKET_ROWS)
    wanted = F.array(*[F.lit(t) for t in sorted(trigrams)])
    low = F.lower(text_or_empty(text_col))
    terms = docs.select(
        text_key(text_or_empty(text_col)).alias("key"),
        F.explode(let(low, lambda text: F.filter(wanted, lambda t: F.contains(text, t)))).alias("trigram"),
    )
    bucket = F.pmod(F.col("key"), F.lit(buckets)).alias("bucket")
    return terms.groupBy(bucket, "trigram").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(key, bits)``: for every candidate text, one bit per rule whose query its trigrams satisfy."""
    nothing = F.array().cast("array<bigint>")
    postings = F.col("postings")

    def posting(trigram: str) -> Column:
        return F.coalesce(F.try_element_at(postings, F.lit(trigram)), nothing)

    def branch(trigrams: frozenset[str]) -> Column:
        return reduce(F.array_intersect, [posting(t) for t in sorted(trigrams)])

    answers = []
    for place, rule in enumerate(rules):
        if query := trigram_query(rule.pattern):
            keys = reduce(F.array_union, [branch(b) for b in sorted(query, key=sorted)])
            answers.append(F.struct(F.lit(1 << place).cast("long").alias("bit"), keys.alias("keys")))
    by_bucket = index.groupBy("bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings")
    )
    found = by_bucket.select(F.inline(F.array(*answers))).select("bit", F.explode("keys").alias("key"))
    return found.groupBy("key").agg(F.bit_or("bit").alias("bits"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans ``(start, end)`` of a rule's matches in code points, leftmost and without overlap.

    The text between matches and the matches themselves alternate; their lengths, added up, are the
    places. Sums are taken in chunks, so that many matches in one text cost no more than in several.
    """
    pattern = F.lit(rule.pattern)
    lengths = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("match")),
    )
    # the gap after the last match has no match beside it
    lengths = F.filter(lengths, lambda x: x["match"].isNotNull())

    def chunked(pairs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")),
            lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK),
        )

    nowhere = F.array().cast("array<struct<start:int,end:int>>")

    def placed(pairs: Column, origin: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + x["match"]
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

        begin = F.struct(origin.alias("at"), nowhere.alias("spans"))
        return F.aggregate(pairs, begin, step, lambda s: s["spans"])

    def origins(chunks: Column) -> Column:
        width = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["match"]))
        return F.aggregate(
            width,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
            lambda s: s["all"],
        )

    def all_spans(pairs: Column) -> Column:
        many = let(chunked(pairs), lambda chunks: F.flatten(F.zip_with(chunks, origins(chunks), placed)))
        return F.when(F.size(pairs) == 0, nowhere).otherwise(many)

    spans = let(lengths, all_spans)
    if not rule.least:
        return spans
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    kept = F.filter(
        F.arrays_zip(spans.alias("span"), F.transform(checked, F.length).alias("n")), lambda x: x["n"] >= rule.least
    )
    return F.transform(kept, lambda x: x["span"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(id, spans)`` for every row: array of (start, rank, kind, end), sorted; NULL text has none.

    The candidates are written first: the join then knows their size and is broadcast only below the
    session's threshold. Runs jobs while it is called.
    """
    spark = docs.sparkSession
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    trigrams = {t for query in queries.values() for branch in query for t in branch}
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), text.alias("_text"), text_key(text).alias("_key"))
    if trigrams:
        path = scratch_path(spark, "secret-candidates")
        candidates(trigram_index(docs, sorted(trigrams), text_col), rules).write.parquet(path)
        chosen = spark.read.parquet(path).select(F.col("key").alias("_key"), "bits")
        rows = rows.join(chosen, "_key", "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("bits", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def named(place: int, rule: Rule) -> Column:
        def name(s: Column) -> Column:
            return F.struct(s["start"].alias("start"), F.lit(place).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"))

        return F.transform(spans_of(F.col("_text"), rule), name)

    parts = []
    for place, rule in enumerate(rules):
        chosen = F.col("bits").bitwiseAND(F.lit(1 << place)) != 0
        wanted = chosen if queries[rule.kind] else F.col("_text").rlike(rule.pattern)
        parts.append(F.when(wanted, named(place, rule)).otherwise(none))
    return rows.select(id_col, F.sort_array(F.concat(*parts)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
