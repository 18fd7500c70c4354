"""Interaction audit of corpus filters, with exact duplicates found in radix text tries.

What the five filters do to each other follows from one bitmask per document: which of them it fails.
Four bits come from the text itself. The fifth, "identical to the text of a document with a smaller
id", comes from compressed tries that hold whole texts and, at their terminals, the smallest id:

1. every input task inserts its texts into a trie of bounded size. A row above the smallest id of its
   terminal is a duplicate already, so it goes on as a mask without text. What is left is one row per
   distinct text, so a text that fills a third of the table leaves one row per task;
2. these rows are range-partitioned by adaptive text prefixes: each border is the shortest prefix that
   parts two neighbours of a hash sample of distinct texts, however long their common beginning is;
3. every range has one trie; walking it compares each row with the smallest id of its terminal.

Masks are then counted by part, label flags and mask, at most 128 rows a part, and all orders of the
filters are read off these counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scratch import materialize

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
# Fixed values of the filters: least words, least share of distinct words, greatest share of capitals, signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
# A trie of an input task is emptied at this size of texts, or with this many rows that have no text.
TRIE_BYTES = 32 << 20
HELD_ROWS = 100_000
# Distinct texts that are sampled for each range, and the most bytes that all borders may have together.
SAMPLED_PER_RANGE = 32
BORDER_BYTES = 32 << 20
BEGINNING_CHARS = 64

_ROWS = pa.schema([("bucket", pa.int32()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_ROWS_SQL = "bucket int, text binary, doc_id long, part string, mask int, n long"


def text_mask(text: bytes) -> int:
    """Bits of the four filters that look at the text alone."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * len(text.translate(None, _CONTINUED))) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


class Node:
    """An inner place of the trie: edges by first byte, and the terminal of a text that ends here."""

    __slots__ = ("edges", "terminal")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, int, int, Node]] = {}  # text, begin and end of the label, node below
        self.terminal: Terminal | None = None


class Terminal:
    """A whole text with the smallest id seen, the rows that have it, and the bits of the text."""

    __slots__ = ("text", "mask", "least", "rows")

    def __init__(self, text: bytes):
        self.text, self.mask, self.least = text, None, None
        self.rows: Counter = Counter()


class RadixTrie:
    """Compressed trie of byte strings; labels are spans of inserted texts, nothing is copied."""

    def __init__(self):
        self.root, self.bytes, self.terminals = Node(), 0, []

    def terminal(self, text: bytes) -> Terminal:
        """The terminal of a text, made where it is missing."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            edge = node.edges.get(text[at])
            if edge is None:
                below = Node()
                node.edges[text[at]] = (text, at, size, below)
                node, at = below, size
                break
            label, begin, end, below = edge
            width = min(end - begin, size - at)
            shared = width if label[begin : begin + width] == text[at : at + width] else _common(label, begin, text, at, width)
            if shared < end - begin:
                between = Node()
                between.edges[label[begin + shared]] = (label, begin + shared, end, below)
                node.edges[text[at]] = (label, begin, begin + shared, between)
                below = between
            node, at = below, at + shared
        if node.terminal is None:
            node.terminal = Terminal(text)
            self.bytes += size
            self.terminals.append(node.terminal)
        return node.terminal


def _common(one: bytes, i: int, two: bytes, j: int, width: int) -> int:
    """How many of ``width`` bytes agree, by halving the span in which they first differ."""
    low, high = 0, width
    while high - low > 1:
        middle = (low + high) // 2
        if one[i + low : i + middle] == two[j + low : j + middle]:
            low = middle
        else:
            high = middle
    return low + (one[i + low : i + low + 1] == two[j + low : j + low + 1] and low < width)


def text_borders(docs: DataFrame, text: Column, ranges: int) -> list[bytes]:
    """Borders between ranges of texts, from a hash sample of distinct texts; runs jobs.

    The sample decides about balance only. Each border is the shortest prefix of its text that is
    above the text before it. A border longer than its share of ``BORDER_BYTES`` is left out.
    """
    rows = docs.count()
    share = max(1, rows // (SAMPLED_PER_RANGE * ranges))
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).groupBy("text").agg(F.lit(1))
    # Ranges of the sample go by short beginnings, so that no whole text reaches the driver; equal ones stay together.
    ranged = sample.repartitionByRange(max(1, ranges // 8), F.substring("text", 1, BEGINNING_CHARS))
    ordered = ranged.select(F.col("text").cast("binary").alias("text")).sortWithinPartitions("text")
    longest = BORDER_BYTES // ranges

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, place = None, SAMPLED_PER_RANGE // 2
        for batch in batches:
            out = []
            for value in batch.column(0):
                now = value.as_py()
                if before is not None and place % SAMPLED_PER_RANGE == 0:
                    width = min(len(before), len(now))
                    out.append(now[: (_common(before, 0, now, 0, width) if width else 0) + 1])
                before, place = now, place + 1
            yield pa.record_batch([pa.array([p for p in out if len(p) <= longest], pa.binary())], names=["prefix"])

    return sorted({bytes(r[0]) for r in ordered.mapInArrow(prefixes, "prefix binary").collect()})


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, n)``: how many rows of an id and a part fail which filters; n adds up to all rows.

    NULL texts count as empty, NULL parts as the empty string. A row without id is smaller than no row
    and above none, so it never fails E; rows that repeat an id and its text don't either. Runs jobs
    while it is called, for the borders.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text.cast("binary").alias("text"),
    )
    borders = text_borders(docs, text, ranges)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, settled = RadixTrie(), Counter()
        for batch in batches:
            for doc, part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                end = trie.terminal(value.as_py())
                if end.mask is None:
                    end.mask = text_mask(end.text)
                if doc is None:
                    settled[None, part, end.mask] += 1
                elif end.least is None or doc < end.least:
                    for (known, *_), n in end.rows.items():
                        settled[end.least, known, end.mask | DUPLICATE] += n
                    end.least, end.rows = doc, Counter({(part,): 1})
                elif doc == end.least:
                    end.rows[(part,)] += 1
                else:
                    settled[doc, part, end.mask | DUPLICATE] += 1
                if trie.bytes > TRIE_BYTES or len(settled) > HELD_ROWS:
                    yield from _emptied(trie, settled, borders, ranges)
                    trie, settled = RadixTrie(), Counter()
        yield from _emptied(trie, settled, borders, ranges)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, settled = RadixTrie(), []
        for batch in batches:
            for value, doc, part, mask, n in zip(batch.column(1), *(batch.column(k).to_pylist() for k in range(2, 6))):
                if not value.is_valid:
                    settled.append((doc, part, mask, n))
                    continue
                end = trie.terminal(value.as_py())
                end.mask = mask
                end.least = doc if end.least is None else min(end.least, doc)
                end.rows[doc, part] += n
            yield _masks(settled)
            settled = []
        for end in trie.terminals:
            settled += [(doc, part, end.mask | DUPLICATE * (doc > end.least), n) for (doc, part), n in end.rows.items()]
            if len(settled) >= HELD_ROWS:
                yield _masks(settled)
                settled = []
        yield _masks(settled)

    ranged = rows.mapInArrow(local, _ROWS_SQL).repartitionById(ranges, F.pmod("bucket", F.lit(ranges)))
    return ranged.mapInArrow(across, "doc_id long, part string, mask int, n long")


def _emptied(trie: RadixTrie, settled: Counter, borders: list[bytes], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of a trie: settled ones without text anywhere, the others to the range of their text."""
    out, held = [], 0
    for place, ((doc, part, mask), n) in enumerate(settled.items()):
        out.append((place, None, doc, part, mask, n))
    for end in trie.terminals:
        if end.least is not None:
            bucket = bisect_right(borders, end.text)
            out += [(bucket, end.text, end.least, part, end.mask, n) for (part,), n in end.rows.items()]
            held += len(end.text) * len(end.rows)
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)


def _masks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "part", "mask", "n"])


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, n_good, n_toxic)``; an id that ``labels`` repeats has every flag that one of its rows has."""
    flags = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = masks.join(flags, "doc_id", "left")
    n = F.col("n")
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(n * F.coalesce("good", F.lit(0))).alias("n_good"),
        F.sum(n * F.coalesce("toxic", F.lit(0))).alias("n_toxic"),
    )


def interactions(counts: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, from the counts of masks; one row per part, order and step.

    A document that fails k filters is removed by each of them in one k-th of all orders, which gives
    the sum over the orders without walking through them.
    """
    orders = list(permutations(range(len(FILTERS))))
    steps = [
        ("".join(FILTERS[f] for f in order), step + 1, 1 << order[step], sum(1 << f for f in order[:step]))
        for order in orders
        for step in range(len(order))
    ]
    kinds = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    table = F.from_json(F.lit(_json(steps)), kinds)
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, was = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    removed = fails & ~was

    def total(condition: Column, count: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(count)).otherwise(0)).cast("long")

    share = F.col("n") * F.floor(F.lit(len(orders)) / F.greatest(F.bit_count(mask), F.lit(1)))
    return (
        counts.select("*", F.inline(table))
        .groupBy("part", "filter_order", "step")
        .agg(
            total(~fails & ~was).alias("kept"),
            total(removed).alias("removed"),
            total(fails & was).alias("redundant"),
            total(mask == bit).alias("unique_fails"),
            total(removed, "n_good").alias("good_lost"),
            total(removed, "n_toxic").alias("toxic_lost"),
            F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
        )
    )


def _json(steps: list[tuple]) -> str:
    rows = [f'{{"filter_order":"{o}","step":{s},"bit":{b},"before":{p}}}' for o, s, b, p in steps]
    return "[" + ",".join(rows) + "]"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every place of every order; see ``interactions`` for the columns.

    An empty table has no part and gives no row. Labels without id and labels of unknown documents
    count for nothing.
    """
    counts = materialize(mask_counts(flagged(docs), labels))
    return interactions(counts)
