"""Even parts of a table for work that passes over it many times."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# A part holds so many rows at least, where there are that many, and at most.
LEAST_ROWS, MOST_ROWS = 20_000, 250_000


def part_count(rows: int, cores: int) -> int:
    """One part a core; fewer for a small table, whole rounds of all cores for a large one."""
    if rows <= cores * MOST_ROWS:
        return max(1, min(cores, math.ceil(rows / LEAST_ROWS)))
    return cores * math.ceil(rows / (cores * MOST_ROWS))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows dealt evenly to all cores, in parts of bounded size; ``rows`` is their number, if known.

    Many rows may come from a file of few blocks, or from a join whose small rows were put together into
    one partition. Models would pass over them in one task, hundreds of times.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(part_count(df.count() if rows is None else rows, cores))
