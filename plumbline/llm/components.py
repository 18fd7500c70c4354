"""Connected components over links of any number, as joins and minima on the cluster.

Large-star and small-star steps alternate: every node hands its larger neighbours, then its smaller
ones, to the smallest node it knows. Links never become more; when a round changes nothing, each node
is linked to the smallest node of its component. Every round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scratch import materialize

MAX_ROUNDS = 60


def _smallest(links: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest of a node and its neighbours. The minimum is taken before the shuffle."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.join(_smallest(both), "u").where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = down.join(_smallest(down), "u")
    to_smallest = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    itself = moved.select("u", F.col("m").alias("v"))
    return to_smallest.union(itself).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` to ``(node, root)`` for every node that has a link; root is its smallest node.

    Nodes without links don't appear. Runs jobs while it is called; raises if the rounds don't end.
    """
    current = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        following = materialize(_small_star(_large_star(current)))
        if following.count() == current.count() and following.exceptAll(current).isEmpty():
            roots = following.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return following.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
        current = following
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
