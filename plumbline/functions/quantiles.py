"""Exact quantiles (linear interpolation) that never build an unbounded value map in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.ordered import null_safe_join, running_totals

_BINS = 4096


def clean_double(name: str) -> Column:
    """The column as double with NaN turned into NULL, as missing values are one concept here."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def _narrow(df: DataFrame, targets: dict[int, tuple[str, int, float, float]]) -> dict[int, float]:
    """Order statistics by counting: ``targets`` maps id -> (column, rank, low, high).

    Each round counts the rows of the current bracket in equal-width bins (a tiny shuffle) and keeps
    the bin that holds the rank, until the bin holds one value. Lowest and highest value always fall
    into different bins, so every round makes progress.
    """
    spark = df.sparkSession
    solved = {tid: low for tid, (_, _, low, high) in targets.items() if low == high}
    active = {tid: spec for tid, spec in targets.items() if tid not in solved}
    while active:
        columns = sorted({spec[0] for spec in active.values()})
        # Ranks that share a bracket are counted once.
        shared = {bracket: i for i, bracket in enumerate({(c, low, high) for c, _, low, high in active.values()})}
        brackets = spark.createDataFrame(
            [(i, *bracket) for bracket, i in shared.items()], "bid int, name string, low double, high double"
        )
        ranks = spark.createDataFrame(
            [(tid, shared[c, low, high], rank) for tid, (c, rank, low, high) in active.items()],
            "tid int, bid int, rank long",
        )
        values = df.select([clean_double(c).alias(c) for c in columns]).unpivot([], columns, "name", "x")
        share = (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))
        bin_of = (
            F.when(F.col("x") == F.col("low"), 0)
            .when(F.col("x") == F.col("high"), _BINS - 1)
            .when(F.isnan(share), 1)
            .otherwise(F.least(F.floor(share * _BINS), F.lit(_BINS - 1)))
            .cast("int")
        )
        counted = (
            values.join(F.broadcast(brackets), "name")
            .where(F.col("x").between(F.col("low"), F.col("high")))
            .groupBy("bid", bin_of.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        )
        upto = W.partitionBy("bid").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
        hits = (
            counted.withColumn("cum", F.sum("n").over(upto))
            .join(F.broadcast(ranks), "bid")
            .where((F.col("rank") < F.col("cum")) & (F.col("rank") >= F.col("cum") - F.col("n")))
            .select("tid", (F.col("rank") - F.col("cum") + F.col("n")).alias("rank"), "lo", "hi")
        )
        for row in hits.collect():  # one row per target
            if row["lo"] == row["hi"]:
                solved[row["tid"]] = row["lo"]
                del active[row["tid"]]
            else:
                active[row["tid"]] = (active[row["tid"]][0], row["rank"], row["lo"], row["hi"])
    return solved


def _interpolated(df: DataFrame, stats: dict[str, tuple[int, float, float]], probs: Sequence[float]):
    targets: dict[int, tuple[str, int, float, float]] = {}
    plan: dict[str, list[tuple[int, int, float]]] = {}
    for name, (n, low, high) in stats.items():
        plan[name] = []
        for p in probs:
            h = (n - 1) * p
            pair = []
            for rank in (math.floor(h), math.ceil(h)):
                targets[len(targets)] = (name, rank, low, high)
                pair.append(len(targets) - 1)
            plan[name].append((pair[0], pair[1], h - math.floor(h)))
    values = _narrow(df, targets)
    return {
        name: [values[a] + (values[b] - values[a]) * w for a, b, w in parts] for name, parts in plan.items()
    }


def quantile_aggregates(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, Column]:
    """For each column an array literal, usable in any projection, filter or ``df.agg``.

    One pass takes counts and bounds; the value range is then narrowed by counting, whatever the
    number of rows or distinct values: no task ever holds the values of a column. Runs its jobs while
    it is called. A column without values gives an array of NULLs.
    """
    if not columns:
        return {}
    probe = df.agg(
        *[
            F.struct(
                F.count(clean_double(c)).alias("n"),
                F.min(clean_double(c)).alias("low"),
                F.max(clean_double(c)).alias("high"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    known = {c: (probe[i]["n"], probe[i]["low"], probe[i]["high"]) for i, c in enumerate(columns) if probe[i]["n"]}
    solved = _interpolated(df, known, probs) if known else {}
    return {c: F.array(*[number(v) for v in solved.get(c, [None] * len(probs))]) for c in columns}


def number(value: float | None) -> Column:
    """A statistic as a literal; an unknown one is NULL."""
    return F.lit(value).cast("double")


def column_statistics(df: DataFrame, columns: Sequence[str], *functions) -> list[list[float | None]]:
    """One list of numbers per aggregate function, in column order, from one scan."""
    row = df.agg(*[f(clean_double(c)) for f in functions for c in columns]).first()
    return [list(row[i * len(columns) : (i + 1) * len(columns)]) for i in range(len(functions))]


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles per key: equal values are counted, then running totals give their ranks.

    What is put in order is one row per key and distinct value, so neither a hot key nor a hot value
    fills a block. Returns ``keys`` and one array column ``quantiles`` in the order of ``probs``.
    """
    counted = (
        df.select(*keys, clean_double(value).alias("_v"))
        .where("_v is not null")
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running_totals(counted, {"_upto": "_n"}, ["_v"], keys)
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = null_safe_join(placed, totals, list(keys)) if keys else placed.join(totals)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    h = (F.col("_all") - 1) * F.col("_t.p")
    low, share = F.floor(h), h - F.floor(h)

    def holds(rank: Column) -> Column:
        return (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))

    # A rank between two rows is their weighted mean; the weights are one minus the distances.
    weight = F.when(holds(low), 1 - share).otherwise(0.0) + F.when(holds(low + 1) & (share > 0), share).otherwise(0.0)
    near = ranked.withColumn("_t", F.explode(wanted)).withColumn("_w", weight).where("_w > 0")
    points = near.groupBy(*keys, F.col("_t.i").alias("_i")).agg(F.sum(F.col("_v") * F.col("_w")).alias("_q"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"])
    return points.groupBy(*keys).agg(ordered.alias("quantiles"))


__all__ = [
    "clean_double",
    "column_statistics",
    "grouped_quantiles",
    "number",
    "quantile_aggregates",
]
