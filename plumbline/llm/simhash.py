"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Every document gets a 64-bit fingerprint. Equal fingerprints are merged first. For every distinct
fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints are stored: by the triangle
inequality two fingerprints within ``radius`` differ by at most ``radius`` in every distance, so a
pair is discarded by the largest difference of its table rows and only survivors are compared bit
by bit.

Which pairs are looked at: the 64 bits are cut into parts, of which ``radius`` differing bits leave
enough untouched, so linked fingerprints agree in one choice of parts at least (nothing is lost).
Crowded groups are cut into tiles of bounded size and every pair of tiles is a group of its own.
A group reports a spanning forest of its links, not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plumbline.functions.scratch import materialize
from plumbline.llm.components import components

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
PIVOTS = 32
TILE = 1024
# Expected fingerprints of a group before more parts are used; changes the plan, never the result.
GROUP_ROWS = 256
MAX_PARTS = 8
_BLOCK = 1 << 16
_PAIRS = 1 << 18

LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint_of(text: bytes, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the word shingles of a text (A-Z lower-cased); 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    k, line = min(words_in_shingle, len(words)), b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for a in range(0, len(starts), _BLOCK):
        shingles = [line[i:j] for i, j in zip(starts[a : a + _BLOCK], ends[a : a + _BLOCK])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words_in_shingle: int = SHINGLE_WORDS) -> Column:
    """Fingerprint column of a text column; NULL counts as a text without words."""

    @arrow_udf(T.LongType())
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t.as_py() or b"", words_in_shingle) for t in batch], pa.int64())

    # Marked so that a filter on the fingerprint, such as a join adds, isn't evaluated by computing it again.
    return compute.asNondeterministic()(text.cast("binary"))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.random.default_rng(SEED).integers(0, 2**64, count, np.uint64)


def pivot_distances(prints: Column) -> Column:
    """The table row of a fingerprint: its Hamming distance to every pivot, one byte each."""
    signed = pivots().view(np.int64).tolist()
    bytes_ = [F.lpad(F.hex(F.bit_count(prints.bitwiseXOR(F.lit(p)))), 2, "0") for p in signed]
    return F.unhex(F.concat(*bytes_))


def part_masks(distinct: int, radius: int = RADIUS) -> list[int]:
    """Masks of which one at least has equal bits in any two fingerprints within ``radius``."""
    for parts in range(radius + 1, MAX_PARTS + 1):
        bits = 64 * (parts - radius) // parts
        if distinct <= GROUP_ROWS << bits or parts == MAX_PARTS:
            break
    edges = np.linspace(0, 64, parts + 1).round().astype(int).tolist()
    spans = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(spans, parts - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _links_of(prints: np.ndarray, table: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int):
    """Index pairs (of ``first`` x ``second``) within ``radius``, found through the pivot tables."""
    order = second[np.argsort(table[second, 0], kind="stable")]
    nearest = table[order, 0].astype(np.int64)
    column = table[first, 0].astype(np.int64)
    low, high = np.searchsorted(nearest, column - radius, "left"), np.searchsorted(nearest, column + radius, "right")
    found_i, found_j, at = [], [], 0
    sizes = high - low
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), _PAIRS, "right")) + at)
        n = sizes[at:upto]
        i = np.repeat(first[at:upto], n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:upto], n)]
        for c in range(1, table.shape[1]):
            near = np.abs(table[i, c].astype(np.int16) - table[j, c]) <= radius
            i, j = i[near], j[near]
            if not len(i):
                break
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        found_i.append(i[near])
        found_j.append(j[near])
        at = upto
    return np.concatenate(found_i or [first[:0]]), np.concatenate(found_j or [first[:0]])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``distinct(fp)`` to ``(u, v)``: links that connect what is within ``radius``, directly or not."""
    masks = part_masks(distinct.count(), radius)
    keys = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]
    keyed = distinct.select("fp", "row", F.inline(F.array(*keys)))
    crowded = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    tiled = keyed.join(crowded, ["part", "key"], "left").withColumns(
        {"tiles": F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")}
    )
    # The part is in the hash so that the tile does not follow the key.
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("fp", "part"), F.col("tiles")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda other: F.struct(
            F.least(F.col("tile"), other).alias("a"), F.greatest(F.col("tile"), other).alias("b")
        ),
    )
    groups = (
        tiled.select("part", "key", "tile", "fp", "row", F.inline(pairs))
        .groupBy("part", "key", "a", "b")
        .agg(F.collect_list(F.struct("fp", "row", (F.col("tile") == F.col("a")).alias("left"))).alias("members"))
        .where(F.size("members") > 1)
        .select((F.col("a") != F.col("b")).alias("two"), "members")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for two, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = members.values
                prints = flat.field("fp").to_numpy().view(np.uint64)
                table = np.frombuffer(b"".join(flat.field("row").to_pylist()), np.uint8).reshape(len(prints), -1)
                if two:
                    left = flat.field("left").to_numpy(zero_copy_only=False)
                    i, j = _links_of(prints, table, np.nonzero(left)[0], np.nonzero(~left)[0], radius)
                else:
                    every = np.arange(len(prints))
                    i, j = _links_of(prints, table, every, every, radius)
                    i, j = i[i < j], j[i < j]
                if len(i):
                    roots = _forest(len(prints), i, j)
                    joined = np.nonzero(roots != np.arange(len(roots)))[0]
                    u.append(prints[joined])
                    v.append(prints[roots[joined]])
            if u:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], LINK)

    return groups.mapInArrow(search, "u long, v long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints(doc_id, fp)`` to ``(fp, component_id, winner_fp)``, one row per distinct fingerprint.

    component_id is the smallest id that links reach, NULL only where no id of the class is known;
    winner_fp is the fingerprint of a document with that id. Runs jobs while it is called.
    """
    distinct = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("row", pivot_distances(F.col("fp")))
    )
    roots = components(links(distinct, radius))
    named = distinct.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(
        F.min(F.struct(F.col("least").isNull().alias("unknown"), F.col("least"), F.col("fp").alias("winner_fp"))).alias("best")
    )
    return named.join(best, "root").select("fp", F.col("best.least").alias("component_id"), F.col("best.winner_fp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words_in_shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """``(id, fp, component_id)``, one row per input row; NULL and wordless texts share fingerprint 0."""
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words_in_shingle).alias("fp")))
    found = prints.join(classes(prints, radius).select("fp", "component_id"), "fp")
    return found.select(F.col("doc_id").alias(id_col), "fp", "component_id")


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words_in_shingle: int = SHINGLE_WORDS
) -> DataFrame:
    """One row of each class: that with the smallest id; among repeated rows of that id, the smallest.

    Keeps the columns of ``docs`` whatever their names.
    """
    columns = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.col(id_col).alias("doc_id"),
        fingerprint(F.col(text_col), words_in_shingle).alias("fp"),
    )
    prints = materialize(rows.select("doc_id", "fp"))
    winners = (
        classes(prints, radius)
        .where(F.col("fp") == F.col("winner_fp"))
        .select(F.col("fp").alias("w_fp"), F.col("component_id").alias("w_id"))
    )
    kept = rows.join(winners, (F.col("fp") == F.col("w_fp")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    once = kept.groupBy("fp", "doc_id").agg(F.min("row").alias("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in columns])
