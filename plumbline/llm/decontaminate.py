"""Benchmark decontamination with suffix arrays of the training texts.

Training texts are cut into shards of whole documents. A shard's words become numbers of the test
vocabulary, and the word suffixes that start with a test word are sorted: the shard's suffix array
(a suffix that starts with any other word matches no test suffix). Every distinct suffix of the test
items is then binary-searched in it, which gives its longest verbatim match and, for a matched
window, all places. Suffixes are compared up to the length of the longest test suffix.

The test items are cut into blocks of at most ``BLOCK_WORDS`` words; each block is broadcast and
searched in a pass of its own over the documents, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scratch import scratch_path

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 1 << 20

# Words are runs of [0-9a-z] and of characters beyond ASCII, after A-Z are lower-cased.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


@dataclass
class TestBlock:
    """Suffixes of some items as places in one array of word numbers (from 1; 0 ends an item).

    Only suffixes that are long enough to start a window are listed. Suffixes with the same window
    share its number, so that its places are looked up once.
    """

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    flat: np.ndarray | None = None
    starts: np.ndarray | None = None
    lengths: np.ndarray | None = None
    needs: np.ndarray | None = None  # words that must match for a hit: a window, or a whole short item
    windows: np.ndarray | None = None
    items: list[list[str]] = field(default_factory=list)  # by window

    def build(self, texts: list[tuple[str, list[bytes]]]) -> TestBlock:
        numbers: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        flat: list[int] = []
        suffixes: list[tuple[int, int, int, int]] = []
        for item, words in texts:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            need = min(self.window, len(ids))
            for at in range(len(ids) - need + 1):
                number = numbers.setdefault(tuple(ids[at : at + need]), len(numbers))
                if number == len(owners):
                    owners.append(set())
                owners[number].add(item)
                suffixes.append((len(flat) + at, len(ids) - at, need, number))
            flat += [*ids, 0]
        table = np.array(suffixes, np.int64).reshape(-1, 4)
        self.flat = np.array(flat or [0], np.int32)
        self.starts, self.lengths, self.needs, self.windows = table.T.copy()
        # An item without id is found like any other; there is only nothing to name it by.
        self.items = [sorted(o - {None}) for o in owners]
        return self


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``words`` that begin above 0, sorted by their first ``depth`` numbers.

    The numbers end in a 0, and nothing is compared beyond the first 0 of a suffix. Several numbers
    are packed into the first sort key; then the known length doubles, among those suffixes only
    that are still tied and not at their end.
    """
    starts = np.nonzero(words)[0]
    if not len(starts):
        return starts
    bits = max(1, int(words.max()).bit_length())
    known = max(1, 62 // bits)
    padded = np.concatenate([words, np.zeros(known, words.dtype)]).astype(np.int64)
    alive, key = np.ones(len(starts), bool), np.zeros(len(starts), np.int64)
    for k in range(known):
        value = np.where(alive, padded[starts + k], 0)
        alive &= value > 0
        key = key << bits | value
    order = np.argsort(key, kind="stable")
    ends = np.append(np.nonzero(words == 0)[0], len(words))
    room = ends[np.searchsorted(ends, starts)] - starts
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    slot = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))  # of each suffix's group
    rank = np.zeros(len(words) + 1, np.int64)  # by place; 0 where no suffix starts
    rank[starts[order]] = slot + 1
    while known < depth:
        tied = np.bincount(slot, minlength=len(order)) > 1
        longer = np.zeros(len(order), bool)
        longer[slot[room[order] > known]] = True
        at = np.nonzero((tied & longer)[slot])[0]
        if not len(at):
            break
        members = order[at]
        beyond = np.minimum(starts[members] + known, len(words))
        follow = np.where(room[members] > known, rank[beyond], 0)
        by = np.lexsort((follow, slot[at]))
        members, follow, group = members[by], follow[by], slot[at]
        new = np.concatenate([[True], (np.diff(follow) != 0) | (np.diff(group) != 0)])
        order[at] = members
        slot[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[starts[members]] = slot[at] + 1
        known *= 2
    return starts[order]


def _compare(
    words: np.ndarray, at: np.ndarray, block: TestBlock, which: np.ndarray, limits: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Equal words of text suffixes and test suffixes (up to ``limits``), and the sign of text - test."""
    equal, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    going, first = np.arange(len(at)), block.starts[which]
    k = 0
    while len(going := going[limits[going] > k]):
        text = words[np.minimum(at[going] + k, len(words) - 1)]
        difference = text.astype(np.int64) - block.flat[first[going] + k]
        same = difference == 0
        sign[going[~same]] = np.sign(difference[~same])
        going = going[same]
        equal[going] += 1
        k += 1
    return equal, sign


def _bound(words: np.ndarray, order: np.ndarray, block: TestBlock, which: np.ndarray, limits: np.ndarray, after: bool):
    """Binary search: the first place whose suffix is not before (or is after) each test suffix."""
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    while len(going := np.nonzero(low < high)[0]):
        middle = (low[going] + high[going]) // 2
        _, sign = _compare(words, order[middle], block, which[going], limits[going])
        before = sign <= 0 if after else sign < 0
        low[going[before]] = middle[before] + 1
        high[going[~before]] = middle[~before]
    return low


def longest_matches(words: np.ndarray, order: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Length and one place of the longest verbatim match of every test suffix; place -1 without any.

    The neighbours of a suffix's place in the sorted order share the longest prefix with it.
    """
    every = np.arange(len(block.starts))
    best, where = np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)
    if not len(order):
        return best, where
    at = _bound(words, order, block, every, block.lengths, after=False)
    for neighbour in (at - 1, at):
        inside = np.nonzero((neighbour >= 0) & (neighbour < len(order)))[0]
        place = order[neighbour[inside]]
        equal, _ = _compare(words, place, block, inside, block.lengths[inside])
        better = equal > best[inside]
        best[inside[better]], where[inside[better]] = equal[better], place[better]
    return best, where


def search_shard(words: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places of matched windows: place, words of the window, its number, words matched verbatim.

    The longest match of a suffix tells whether its window occurs at all; only then are all of its
    places looked up. The verbatim length is that of the longest listed suffix of the window.
    """
    order = suffix_array(words, int(block.lengths.max(initial=0)))
    best, _ = longest_matches(words, order, block)
    hit = np.nonzero(best >= block.needs)[0]
    hit = hit[np.argsort(-best[hit], kind="stable")]
    hit = hit[np.unique(block.windows[hit], return_index=True)[1]]
    low = _bound(words, order, block, hit, block.needs[hit], after=False)
    n = _bound(words, order, block, hit, block.needs[hit], after=True) - low
    suffix = np.repeat(hit, n)
    places = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    verbatim, _ = _compare(words, places, block, suffix, block.lengths[suffix])
    return places, block.needs[suffix], block.windows[suffix], verbatim


def _scan(documents: list[list[bytes]], block: TestBlock) -> list[tuple[list[tuple[int, int]], list[str], int]]:
    """Per document: matched word spans (merged), ids of items with matched windows, longest match in words."""
    found = []
    number, at = block.vocabulary.get, 0
    while at < len(documents):
        size, upto = 0, at
        while upto < len(documents) and (upto == at or size + len(documents[upto]) <= SHARD_WORDS):
            size += len(documents[upto])
            upto += 1
        docs = documents[at:upto]
        numbered = chain.from_iterable(chain(map(number, words, repeat(0)), (0,)) for words in docs)
        flat = np.fromiter(numbered, np.int32, size + len(docs))
        starts = np.cumsum([0] + [len(words) + 1 for words in docs])
        places, lengths, windows, verbatim = search_shard(flat, block)
        owner = np.searchsorted(starts, places, "right") - 1
        by_doc = np.lexsort((places, owner))
        cut = np.searchsorted(owner[by_doc], np.arange(len(docs) + 1)).tolist()
        for d in range(len(docs)):
            mine = by_doc[cut[d] : cut[d + 1]]
            spans = zip((places[mine] - starts[d]).tolist(), (places[mine] + lengths[mine] - starts[d]).tolist())
            items = {i for w in set(windows[mine].tolist()) for i in block.items[w]}
            found.append((_merged(spans), sorted(items), int(verbatim[mine].max(initial=0))))
        at = upto
    return found


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[TestBlock]:
    """The items in blocks of bounded size, read from the cluster one part at a time.

    Items without words have no windows; those of items with a NULL id are found, but not named. Without any
    item there is one empty block. A single item longer than a block is a block by itself.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    held, size, cut = [], 0, False
    for row in rows.where("text is not null").toLocalIterator():
        words = words_of(bytes(row["text"]))
        if held and size + len(words) > block_words:
            yield TestBlock(window).build(held)
            held, size, cut = [], 0, True
        if words:
            held.append((row["item"], words))
            size += len(words)
    if held or not cut:
        yield TestBlock(window).build(held)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The columns ``keep`` of every document with n_words, matched word spans, item ids and longest match.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. NULL text
    has no words. One pass over the documents per block of the benchmark, usually one in all; the
    spans found so far travel with the rows between passes.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("none"))
    state = docs.select(row.alias("row"), F.col(text_col).cast("binary").alias("body")).selectExpr(
        "row", "body", "cast(0 as bigint) as n_words", "cast(array() as array<struct<start:bigint,end:bigint>>) as spans",
        "cast(array() as array<string>) as items", "cast(0 as bigint) as longest",
    )
    schema, blocks = state.schema, test_blocks(benchmark, item_col, item_text_col, window, block_words)
    for number, block in enumerate(blocks):
        if number:  # the passes before are done, not chained into one task
            path = scratch_path(spark, "matches")
            state.write.parquet(path)
            state = spark.read.parquet(path)
        state = state.mapInArrow(_pass(spark.sparkContext.broadcast(block), schema), schema)
    return state.select(*[F.col("row")[c].alias(c) for c in keep], "n_words", "spans", "items", "longest")


def _pass(block: Broadcast, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [words_of(t) for t in texts]
            found = _scan(words, block.value)
            old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            spans = [
                _merged([(s["start"], s["end"]) for s in old] + new[0]) if old or new[0] else [] for old, new in zip(old_spans, found)
            ]
            items = [sorted({*old, *new[1]}) if old or new[1] else [] for old, new in zip(old_items, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], out.field(3).type),
                    pa.array(items, out.field(4).type),
                    pa.array([max(a, b[2]) for a, b in zip(batch.column(5).to_pylist(), found)], pa.int64()),
                ],
                names=out.names,
            )

    return scan


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any matched window, with the columns of ``docs`` whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("body"))
    found = matches(rows, benchmark, ["doc"], "body", window=window)
    return found.where(F.size("spans") == 0).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
