"""Density-based clustering (DBSCAN) by a grid, exact and without pairing all points of a cell.

Cells have the side ``eps / sqrt(d)``, so any two points of one cell are neighbours:

* a cell holding ``min_samples`` rows makes all its points core points without looking at pairs;
* only points of sparser cells are compared with neighbouring cells, fewer than ``min_samples`` each;
* cells, not points, are the nodes of the connectivity graph. Two cells are linked when some core
  points of theirs are neighbours, which is decided on shrinking sub-boxes.

Identical points are merged first, so many copies of one row cost as much as a single one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.ordered import POSITION, with_position
from plumbline.functions.quantiles import clean_double
from plumbline.functions.scratch import materialize
from plumbline.functions.statistics import safe_divide

# A cell with more distinct points than this is split into several join groups.
_POINTS_PER_SALT = 20_000
# Pairs of boxes with at most this many point pairs are compared point by point.
_DIRECT_PAIRS = 4_096
# Dimensions used to look up neighbouring cells; the exact box distance decides afterwards.
_LOOKUP_DIMS = 3


def _distance2(a: Column, b: Column, dims: int) -> Column:
    if dims <= 16:
        total = (a[0] - b[0]) * (a[0] - b[0])
        for i in range(1, dims):
            total = total + (a[i] - b[i]) * (a[i] - b[i])
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _box_distance2(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, far: bool) -> Column:
    """Smallest (or, with ``far``, largest) squared distance between two boxes."""
    gaps = F.zip_with(
        F.arrays_zip(lo_a.alias("lo"), hi_a.alias("hi")),
        F.arrays_zip(lo_b.alias("lo"), hi_b.alias("hi")),
        (lambda a, b: F.greatest(a["hi"] - b["lo"], b["hi"] - a["lo"]))
        if far
        else (lambda a, b: F.greatest(a["lo"] - b["hi"], b["lo"] - a["hi"], F.lit(0.0))),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _neighbour_cells(cells: DataFrame, dims: int, eps: float, side: float) -> DataFrame:
    """``(a, b)`` of cell ids whose boxes are at most ``eps`` apart, both directions and a = b included."""
    reach = math.floor(math.sqrt(dims)) + 1
    lookup = min(dims, _LOOKUP_DIMS)
    coarse = [F.floor(F.col("grid")[j] / F.lit(reach)).cast("long") for j in range(lookup)]
    keyed = cells.select("cell", "grid", *[c.alias(f"k{j}") for j, c in enumerate(coarse)])
    shifted = keyed
    for j in range(lookup):
        steps = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        shifted = shifted.withColumn("_step", steps).withColumn(f"k{j}", F.col(f"k{j}") + F.col("_step")).drop("_step")
    left = shifted.select(F.col("cell").alias("a"), F.col("grid").alias("ga"), *[f"k{j}" for j in range(lookup)])
    right = keyed.select(F.col("cell").alias("b"), F.col("grid").alias("gb"), *[f"k{j}" for j in range(lookup)])
    steps_apart = F.zip_with("ga", "gb", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double"))
    apart2 = F.aggregate(steps_apart, F.lit(0.0), lambda s, v: s + v * v) * F.lit(side * side)
    return left.join(right, [f"k{j}" for j in range(lookup)]).where(apart2 <= eps * eps).select("a", "b")


def _with_neighbours(few: DataFrame, pairs: DataFrame, many: DataFrame, salts: DataFrame) -> DataFrame:
    """Join points of sparse cells with the points of neighbouring cells.

    Points of a crowded cell are spread over several salts, so no join group grows with the cell.
    """
    left = (
        few.select(F.col("site").alias("p"), F.col("x").alias("px"), F.col("cell").alias("a"))
        .join(pairs, "a")
        .join(salts, "b")
        .select("p", "px", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    right = many.join(salts.withColumnRenamed("b", "cell"), "cell").select(
        F.col("cell").alias("b"),
        F.pmod(F.xxhash64("site"), F.col("salts")).cast("int").alias("salt"),
        F.col("site").alias("q"),
        F.col("x").alias("qx"),
        *[c for c in many.columns if c not in ("site", "x", "cell")],
    )
    return left.join(right, ["b", "salt"])


def _grid_index(width: float) -> Column:
    """Index of the grid cell of the given width that holds the point ``x``."""
    return F.transform("x", lambda v: F.floor(v / F.lit(width)).cast("long"))


def _boxes(core: DataFrame, dims: int, width: float) -> DataFrame:
    """Bounding boxes of the core points inside sub-cells of the given width."""
    return core.groupBy("cell", _grid_index(width).alias("sub")).agg(
        F.array(*[F.min(F.col("x")[j]) for j in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("x")[j]) for j in range(dims)]).alias("hi"),
        F.count(F.lit(1)).alias("m"),
    )


def _linked_cells(core: DataFrame, pairs: DataFrame, dims: int, eps: float, side: float) -> DataFrame:
    """``(a, b)`` with a < b: neighbouring cells that hold core points at most ``eps`` apart."""
    limit = F.lit(eps * eps)
    cells = core.select("cell").distinct()
    open_pairs = (
        pairs.where("a < b")
        .join(cells.withColumnRenamed("cell", "a"), "a", "left_semi")
        .join(cells.withColumnRenamed("cell", "b"), "b", "left_semi")
    )
    linked = None
    parents = open_pairs.select("a", "b", F.lit(None).cast("array<long>").alias("pa"), F.lit(None).cast("array<long>").alias("pb"))
    width, level = side, 0
    while True:
        boxes = _boxes(core, dims, width)
        # The parent of a sub-cell has twice its width, so its index is halved.
        up = F.transform("sub", lambda v: F.floor(v / F.lit(2)).cast("long"))
        parent = F.lit(None).cast("array<long>") if level == 0 else up
        tree = boxes.select("cell", "sub", "lo", "hi", "m", parent.alias("parent"))
        side_a = tree.select(*[F.col(c).alias(f"{c}_a") for c in tree.columns])
        side_b = tree.select(*[F.col(c).alias(f"{c}_b") for c in tree.columns])
        met = parents.join(
            side_a, (F.col("a") == F.col("cell_a")) & F.col("pa").eqNullSafe(F.col("parent_a"))
        ).join(side_b, (F.col("b") == F.col("cell_b")) & F.col("pb").eqNullSafe(F.col("parent_b")))
        near = _box_distance2(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"), far=False)
        far = _box_distance2(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"), far=True)
        rated = materialize(
            met.withColumn("near", near).withColumn("far", far).where(F.col("near") <= limit * (1 + 1e-9)).select(
                "a", "b", "sub_a", "sub_b", "far", (F.col("m_a") * F.col("m_b")).alias("work")
            )
        )
        sure = rated.where(F.col("far") <= limit * (1 - 1e-9)).select("a", "b").distinct()
        rest = rated.join(sure, ["a", "b"], "left_anti")
        placed = core.select("cell", _grid_index(width).alias("sub"), "x")
        checked = (
            rest.where(F.col("work") <= _DIRECT_PAIRS)
            .join(placed.select(F.col("cell").alias("a"), F.col("sub").alias("sub_a"), F.col("x").alias("xa")), ["a", "sub_a"])
            .join(placed.select(F.col("cell").alias("b"), F.col("sub").alias("sub_b"), F.col("x").alias("xb")), ["b", "sub_b"])
            .where(_distance2(F.col("xa"), F.col("xb"), dims) <= limit)
            .select("a", "b")
            .distinct()
        )
        found = materialize(sure.unionByName(checked).distinct())
        linked = found if linked is None else linked.unionByName(found)
        parents = materialize(
            rest.where(F.col("work") > _DIRECT_PAIRS)
            .join(found, ["a", "b"], "left_anti")
            .select("a", "b", F.col("sub_a").alias("pa"), F.col("sub_b").alias("pb"))
        )
        if parents.isEmpty():
            return linked.distinct()
        width, level = width / 2, level + 1


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node id of each component.

    Labels move to the smallest neighbouring label and then to the label of their label, which
    shortens long chains; every round is checkpointed.
    """
    both = materialize(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    )
    labels = materialize(nodes.select("node", F.col("node").alias("label")))
    while True:
        heard = (
            both.join(labels, F.col("v") == F.col("node"))
            .groupBy("u")
            .agg(F.min("label").alias("offer"))
        )
        moved = labels.join(heard, F.col("node") == F.col("u"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        # Follow each label to the label it has itself received.
        lookup = moved.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = materialize(
            moved.join(lookup, F.col("label") == F.col("root"), "left").select(
                "node", "old", F.least("label", "root_label").alias("label")
            )
        )
        changed = not jumped.where("label <> old").isEmpty()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def dbscan(
    df: DataFrame, id_column: str, columns: Sequence[str], eps: float = 0.5, min_samples: int = 5, renumber: bool = True
) -> DataFrame:
    """``(id, cluster, is_core)`` for every row with complete features; noise is -1.

    A point counts itself. A border point joins the lowest-numbered of its core neighbours' clusters.
    Clusters are numbered by their smallest core id; without ``renumber`` they keep that id as name.
    """
    dims = len(columns)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    x = F.array(*[clean_double(c) + 0.0 for c in columns])
    rows = df.na.drop(subset=list(columns)).select(F.col(id_column).alias("id"), x.alias("x"))
    sites = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("site"))
    sites = sites.withColumn("grid", _grid_index(side))
    summary = sites.groupBy("grid").agg(
        F.min("site").alias("cell"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")
    )
    cells = materialize(summary)
    sites = materialize(sites.join(cells.select("grid", "cell", "total"), "grid").drop("grid"))
    pairs = materialize(_neighbour_cells(cells, dims, eps, side))
    salts = cells.select(F.col("cell").alias("b"), F.ceil(F.col("m") / _POINTS_PER_SALT).cast("int").alias("salts"))

    close = _distance2(F.col("px"), F.col("qx"), dims) <= F.lit(eps * eps)
    sparse = sites.where(F.col("total") < min_samples)
    counted = (
        _with_neighbours(sparse, pairs, sites.select("site", "x", "cell", "n"), salts)
        .where(close)
        .groupBy("p")
        .agg(F.sum("n").alias("near"))
    )
    judged = materialize(
        sites.join(counted, F.col("site") == F.col("p"), "left").select(
            "site",
            "x",
            "cell",
            ((F.col("total") >= min_samples) | (F.coalesce("near", F.lit(0)) >= min_samples)).alias("core"),
        )
    )
    core = judged.where("core")
    edges = _linked_cells(core, pairs, dims, eps, side)
    groups = connected_components(core.select(F.col("cell").alias("node")).distinct(), edges)
    named = core.join(groups, F.col("cell") == F.col("node")).select("site", "x", "cell", "label")
    names = named.groupBy("label").agg(F.min("site").alias("cluster"))
    if renumber:
        names = with_position(names, ["cluster"]).select("label", F.col(POSITION).alias("cluster"))
    core_named = materialize(named.join(names, "label").select("site", "x", "cell", "cluster"))
    border = (
        _with_neighbours(judged.where("not core"), pairs, core_named, salts)
        .where(close)
        .groupBy(F.col("p").alias("site"))
        .agg(F.min("cluster").alias("cluster"))
    )
    labels = core_named.select("site", "cluster", F.lit(True).alias("is_core")).unionByName(
        border.select("site", "cluster", F.lit(False).alias("is_core"))
    )
    site_labels = judged.select("site", "x").join(labels, "site", "left").select(
        "x", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )
    return rows.join(site_labels, "x").select(F.col("id").alias(id_column), "cluster", "is_core")


def dbscan_summary(labelled: DataFrame) -> DataFrame:
    """One row: points, clusters, core points, noise points and their share."""
    found = labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("is_core").alias("_core")
    )
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("_n"))), F.lit(0))
    return found.agg(
        F.sum("_n").alias("points"),
        F.count_if(F.col("cluster") >= 0).alias("clusters"),
        F.sum("_core").alias("core_points"),
        noise.alias("noise"),
        F.round(safe_divide(noise * 100, F.sum("_n")), 4).alias("noise_pct"),
    )


def silhouette_without_noise(
    df: DataFrame, labelled: DataFrame, id_column: str, columns: Sequence[str]
) -> DataFrame:
    """One row ``(clusters, silhouette)`` over the clustered rows; NULL unless there are two clusters."""
    kept = labelled.where("cluster >= 0")
    clusters = kept.select("cluster").distinct().count()
    score = None
    if clusters > 1:
        vector = array_to_vector(F.array(*[clean_double(c) for c in columns]))
        rows = df.join(kept, id_column).select(vector.alias("features"), F.col("cluster").cast("double").alias("prediction"))
        score = float(ClusteringEvaluator().evaluate(rows))
    return df.sparkSession.createDataFrame([(clusters, score)], "clusters int, silhouette double")
