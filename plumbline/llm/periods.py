"""Periodic runs in texts, found as maximal pairs of repeated word sequences.

A run is a stretch of words with smallest period ``q`` and a length of at least two periods that no
neighbouring word continues. Two occurrences of a word sequence, ``q`` words apart, form a maximal pair
if neither the words before them nor those behind them agree. A stretch of length L is a run with a
period ``q`` exactly if its first ``L - q`` words and its last ``L - q`` words are a maximal pair with
``q <= L - q``, so nothing has to be extended; multiples of the period name the same stretch, and the
smallest distance of a stretch is its period.

Pairs come from the tree of LCP intervals, bottom-up: every interval holds the places of its suffixes
in lists by the word to their left. Where two children meet, each place of the smaller one looks up
the other one's lists of different left words, within the distance that the common length allows.
Suffixes that share fewer than half of ``least`` words can't be in such a pair and leave before that.

Texts are worked on side by side: words are numbered per text, so no match crosses a border. One text
stays in one task, whose memory grows with the words of its repeated parts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# A run has at least this many words.
LEAST_WORDS = 12
# Words that are worked on at once, unless a single text has more.
BLOCK_WORDS = 100_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Occurrences:
    """Places of one LCP interval: all in order, and by the word to their left."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}

    def add(self, place: int, left: int) -> None:
        insort(self.places, place)
        own = self.classes.get(left)
        if own is None:
            self.classes[left] = [place]
        else:
            insort(own, place)

    def partners(self, place: int, left: int, reach: int, lefts: list[int]) -> Iterator[int]:
        """Places within ``reach`` of ``place`` behind another word than ``left``."""
        a = bisect_left(self.places, place - reach)
        b = bisect_right(self.places, place + reach, a)
        if b - a <= len(self.classes):
            for other in self.places[a:b]:
                if lefts[other] != left:
                    yield other
            return
        for word, own in self.classes.items():
            if word != left:
                yield from own[bisect_left(own, place - reach) : bisect_right(own, place + reach)]


def _grams(ranks: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the sequences that start with one of ``ranks`` and go on with that ``width`` places on."""
    behind = np.full(len(ranks), -1, np.int64)
    behind[: len(ranks) - width] = ranks[width:]
    return np.unique(ranks * (len(ranks) + 1) + behind + 1, return_inverse=True)[1]


def _suffixes(words: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose first ``shared`` words occur again, as a suffix array, and their LCPs with the one before.

    LCPs below ``shared`` are given as 0.
    """
    levels, width = [words], 1
    while 2 * width <= shared:
        levels.append(_grams(levels[-1], width))
        width *= 2
    ranks = _grams(levels[-1], shared - width) if width < shared else levels[-1]
    steps = [(1 << k, level) for k, level in enumerate(levels)]
    order = np.argsort(ranks, kind="stable")
    ordered = ranks[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    group = np.nonzero(fresh)[0][np.cumsum(fresh) - 1]
    again = np.zeros(len(order), bool)
    again[:-1] |= ~fresh[1:]
    again[1:] |= ~fresh[1:]
    # From here a rank is the place of the first member of its group in the suffix array.
    current = np.empty(len(order) + 1, np.int32)
    current[order], current[-1] = group, -1
    kept = active = np.sort(order[again])
    width, steps = shared, [s for s in steps if s[0] < shared]
    while True:
        steps.append((width, current[:-1]))
        if not len(active):
            break
        first, second = current[active], current[np.minimum(active + width, len(order))]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        new_group = np.ones(len(by), bool)
        new_group[1:] = first[1:] != first[:-1]
        new_part = new_group.copy()
        new_part[1:] |= second[1:] != second[:-1]
        at = np.arange(len(by))
        parts = at[new_part][np.cumsum(new_part) - 1]
        current = current.copy()
        current[active] = first + parts - at[new_group][np.cumsum(new_group) - 1]
        alone = new_part & np.append(new_part[1:], True)
        active = active[~alone]
        width *= 2
    array = kept[np.argsort(current[kept], kind="stable")]
    common = np.zeros(len(array), np.int64)
    if len(array):
        a, b = array[:-1], array[1:]
        same = ranks[a] == ranks[b]
        a, b = a[same], b[same]
        total = np.zeros(len(a), np.int64)
        # The widest level first; below ``shared`` words the powers of two make up the rest.
        for step, level in reversed(steps):
            i, j = a + total, b + total
            inside = np.maximum(i, j) < len(words)
            equal = inside.copy()
            equal[inside] = level[i[inside]] == level[j[inside]]
            total += step * equal
        common[1:][same] = total
    return array, common


def _pairs(array: np.ndarray, common: np.ndarray, lefts: list[int], least: int) -> dict[tuple[int, int], int]:
    """Smallest distance of the maximal pairs of every stretch (start, end)."""
    found: dict[tuple[int, int], int] = {}

    def meet(node: Occurrences, place: int, length: int) -> None:
        for other in node.partners(place, lefts[place], length, lefts):
            distance = abs(other - place)
            if distance + length >= least:
                start = min(other, place)
                key = (start, start + distance + length)
                if distance < found.get(key, distance + 1):
                    found[key] = distance

    def merged(one: Occurrences | int, two: Occurrences | int, length: int) -> Occurrences:
        if isinstance(one, int):
            one = Occurrences(one, lefts[one])
        if isinstance(two, int):
            meet(one, two, length)
            one.add(two, lefts[two])
            return one
        if len(one.places) < len(two.places):
            one, two = two, one
        for place in two.places:
            meet(one, place, length)
        for place in two.places:
            one.add(place, lefts[place])
        return one

    nodes: list[Occurrences | int] = []
    lengths: list[int] = []  # what each open node shares with the one below it
    for place, length in zip(array.tolist(), common.tolist()):
        while lengths and lengths[-1] >= length:
            shared = lengths.pop()
            top = nodes.pop()
            if shared:
                top = top if not isinstance(nodes[-1], int) or isinstance(top, int) else _swap(nodes, top)
                nodes[-1] = merged(nodes[-1], top, shared)
            else:
                nodes.clear()
                lengths.clear()
        if not length:
            nodes.clear()
            lengths.clear()
        nodes.append(place)
        lengths.append(length)
    while len(nodes) > 1:
        shared, top = lengths.pop(), nodes.pop()
        if shared:
            top = top if not isinstance(nodes[-1], int) or isinstance(top, int) else _swap(nodes, top)
            nodes[-1] = merged(nodes[-1], top, shared)
    return found


def _swap(nodes: list, top: Occurrences) -> int:
    """Let a grown node take the place of the single suffix below it."""
    below, nodes[-1] = nodes[-1], top
    return below


def runs_of(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every list of words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    if not len(flat):
        return out
    owner = np.repeat(np.arange(len(texts)), sizes)
    words = np.unique(owner * len(numbers) + flat, return_inverse=True)[1]
    array, common = _suffixes(words, max(1, (least + 1) // 2))
    if not len(array):
        return out
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = -1  # no word: there is one such place in a text, and it equals no other
    for (start, end), period in _pairs(array, common, before.tolist(), least).items():
        text = int(owner[start])
        out[text].append((start - int(starts[text]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of all repetitions: of each run its first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    kept = (np.cumsum(depth[:-1]) == 0).tolist()
    return b" ".join(w for w, k in zip(words, kept) if k)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``(id, n_words, runs, collapsed)``, one row per input row; ids pass through as they are.

    Words are maximal runs of other characters than blanks and line ends. NULL, empty and blank texts
    have no words and no runs, and collapse to the empty text.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`"), text.alias("_text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for block in _blocks(batch.column(1)):
                for words, found in zip(block, runs_of(block, least)):
                    counts.append(len(words))
                    runs.append(found)
                    texts.append(collapsed(words, found))
            flat = [r for found in runs for r in found]
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(_ARROW_RUN)))
            parts = [batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(parts, names=[id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(find, T.StructType([rows.schema[0], *FOUND]))


def _blocks(batch: pa.Array) -> Iterator[list[list[bytes]]]:
    block, held = [], 0
    for text in batch:
        words = (text.as_py() or b"").split()
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append(words)
        held += len(words)
    if block:
        yield block


def long_form(found: Column) -> Column:
    """``start,length,period`` and a line end for every run, in order."""
    return F.array_join(F.transform(found, lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
