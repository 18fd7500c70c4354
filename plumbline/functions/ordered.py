"""Global row order without a single-task window.

A window with no ``partitionBy`` (or with one hot key) moves everything into one task. Here rows
are range-partitioned on the order columns, so equal keys may span many blocks, and only one small
row per (block, key) takes part in the sequential step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.scratch import materialize

BLOCK = "_block"
INDEX = "_index"
POSITION = "_position"
SERIES_SIZE = "_series_size"
CHUNK = "_chunk"
OWN = "_own"

# monotonically_increasing_id keeps the partition id above bit 33 and the row index below it.
_INDEX_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL matches NULL; the right copies of the join columns are dropped."""
    renamed = right
    condition = None
    for name in on:
        renamed = renamed.withColumnRenamed(name, f"_r_{name}")
        term = F.col(name).eqNullSafe(F.col(f"_r_{name}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{name}" for name in on])


def _as_columns(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in order_by]


def ordered_blocks(
    df: DataFrame, order_by: Sequence[str | Column], keys: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Range-partition and sort by ``(keys, order_by)``; add the block id and the index inside it.

    The result is checkpointed, because a re-run of the range partitioner may choose other bounds.
    ``order_by`` should end in a tie-breaking column, so that a frequent value can still be split.
    """
    count = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(key) for key in keys] + _as_columns(order_by)
    ranked = (
        df.repartitionByRange(count, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn(BLOCK, F.shiftright("_mono", _INDEX_BITS))
        .withColumn(INDEX, F.col("_mono").bitwiseAND((1 << _INDEX_BITS) - 1))
        .drop("_mono")
    )
    return materialize(ranked)


def _block_windows(keys: Sequence[str]):
    """Windows over the (block, key) summary: at most one row per block and key.

    Looking ahead is looking back in descending order: a frame that shrinks from the front would be
    recomputed for every row.
    """
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = part.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    after = part.orderBy(F.desc(BLOCK)).rowsBetween(W.unboundedPreceding, -1)
    return part, before, after


def with_position(
    df: DataFrame, order_by: Sequence[str | Column], keys: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """Add the exact 0-based position inside each key and the number of rows of the key."""
    rows = ordered_blocks(df, order_by, keys, blocks)
    part, before, _ = _block_windows(keys)
    offsets = (
        rows.groupBy(BLOCK, *keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(INDEX).alias("_first"))
        .select(
            BLOCK,
            *keys,
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(part).alias(SERIES_SIZE),
        )
    )
    return (
        null_safe_join(rows, offsets, [BLOCK, *keys])
        .withColumn(POSITION, F.col(INDEX) + F.col("_shift"))
        .drop(BLOCK, INDEX, "_shift")
    )


def running_totals(
    df: DataFrame,
    sums: Mapping[str, str | Column],
    order_by: Sequence[str | Column],
    keys: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums in the given order, per key, for every entry of ``sums``."""
    inputs = {f"_in_{name}": value for name, value in sums.items()}
    staged = df.withColumns({k: F.col(v) if isinstance(v, str) else v for k, v in inputs.items()})
    rows = ordered_blocks(staged, order_by, keys, blocks)
    _, before, _ = _block_windows(keys)
    inside = W.partitionBy(BLOCK, *keys).orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0)
    carried = (
        rows.groupBy(BLOCK, *keys)
        .agg(*[F.sum(name).alias(name) for name in inputs])
        .select(
            BLOCK, *keys, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_c{name}") for name in inputs]
        )
    )
    joined = null_safe_join(rows, carried, [BLOCK, *keys])
    totals = {name: F.sum(f"_in_{name}").over(inside) + F.col(f"_c_in_{name}") for name in sums}
    helpers = [*inputs, *[f"_c{name}" for name in inputs], BLOCK, INDEX]
    return joined.withColumns(totals).drop(*helpers)


def nearest_known(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str | Column],
    keys: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Add ``_before_<c>`` and ``_after_<c>``: the last known value up to a row and the first from it on."""
    rows = ordered_blocks(df, order_by, keys, blocks)
    _, before, after = _block_windows(keys)
    inside = W.partitionBy(BLOCK, *keys)
    backward = inside.orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0)
    forward = inside.orderBy(F.desc(INDEX)).rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(BLOCK, *keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(INDEX))).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(INDEX))).alias(f"_first_{c}") for c in columns],
    )
    carried = ends.select(
        BLOCK,
        *keys,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_prev_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(after).alias(f"_next_{c}") for c in columns],
    )
    joined = null_safe_join(rows, carried, [BLOCK, *keys])
    found = {}
    for c in columns:
        found[f"_before_{c}"] = F.coalesce(F.last(c, ignorenulls=True).over(backward), F.col(f"_prev_{c}"))
        found[f"_after_{c}"] = F.coalesce(F.last(c, ignorenulls=True).over(forward), F.col(f"_next_{c}"))
    return joined.select(*[F.col(name) for name in df.columns], *[e.alias(name) for name, e in found.items()])


def fill_forward_backward(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str | Column],
    keys: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Replace NULLs by the previous known value in order, leading NULLs by the next known one."""
    rows = nearest_known(df, columns, order_by, keys, blocks)
    filled = {c: F.coalesce(F.col(f"_before_{c}"), F.col(f"_after_{c}")) for c in columns}
    return rows.select(*[filled[name].alias(name) if name in filled else F.col(name) for name in df.columns])


def over_neighbours(
    positioned: DataFrame,
    expressions: Callable[[W], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = (),
    chunk_rows: int = 65_536,
) -> DataFrame:
    """Evaluate row-frame window expressions over rows that carry a position.

    Rows are cut into chunks of equal size and each chunk also receives the ``before`` rows ahead
    of it and the ``after`` rows behind it, so one long series is spread over many tasks.
    ``expressions`` gets the ordered window of a chunk and returns the new columns.
    """
    if before >= chunk_rows or after >= chunk_rows:
        raise ValueError("the frame must be shorter than a chunk")
    chunk = F.floor(F.col(POSITION) / F.lit(chunk_rows)).cast("long")
    offset = F.col(POSITION) % F.lit(chunk_rows)
    homes = [F.struct(chunk.alias(CHUNK), F.lit(True).alias(OWN))]
    if before:
        copy = F.struct((chunk + 1).alias(CHUNK), F.lit(False).alias(OWN))
        homes.append(F.when(offset >= chunk_rows - before, copy))
    if after:
        copy = F.struct((chunk - 1).alias(CHUNK), F.lit(False).alias(OWN))
        homes.append(F.when((offset < after) & (chunk > 0), copy))
    spread = positioned.select("*", F.inline(F.array_compact(F.array(*homes))))
    window = W.partitionBy(*keys, CHUNK).orderBy(POSITION)
    return spread.withColumns(dict(expressions(window))).where(OWN).drop(CHUNK, OWN)
