"""k-means with choice of k, nearest centres and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.parts import spread
from plumbline.functions.quantiles import clean_double
from plumbline.functions.scratch import materialize
from plumbline.operators.clean import impute_mean, standardize

SEED = 42
MAX_ITERATIONS = 300  # the tolerance of k-means usually stops it much earlier


def scaled_vectors(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Mean-imputed, standardised feature vectors; written once because several fits read them."""
    filled = standardize(impute_mean(df, columns), columns, "_std")
    vectors = VectorAssembler(inputCols=[f"{c}_std" for c in columns], outputCol="features").transform(filled)
    return materialize(spread(vectors.select(*keep, "features")))


def kmeans_sweep(
    vectors: DataFrame, per_cluster: int = 5, largest: int = 10, models: dict[int, KMeansModel] | None = None
) -> DataFrame:
    """``(k, inertia, silhouette)`` for k = 2..min(largest, n // per_cluster).

    The silhouette is the squared-Euclidean one, which needs two passes instead of all pairs. ``models``
    receives the fitted models (some centres each), so that the chosen one need not be fitted again.
    """
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)  # every iteration reads them
    n = vectors.count()
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    rows = []
    for k in range(2, min(largest, n // per_cluster) + 1):
        model = KMeans(k=k, seed=SEED, maxIter=MAX_ITERATIONS).fit(vectors)
        if models is not None:
            models[k] = model
        labelled = model.transform(vectors)
        occupied = sum(1 for size in model.summary.clusterSizes if size > 0)
        silhouette = evaluator.evaluate(labelled) if occupied > 1 else 0.0
        rows.append((k, float(model.summary.trainingCost), float(silhouette)))
    vectors.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def k_by_silhouette(sweep: DataFrame) -> DataFrame:
    """The k with the highest silhouette, the smallest one on a tie."""
    return sweep.agg(F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).alias("k"))


def k_by_ratio(sweep: DataFrame, limit: float = 0.3) -> DataFrame:
    """The first k whose inertia drop is below ``limit`` times the next drop, plus one; 2 if there is none.

    ``sweep`` has one row per k, so the unpartitioned window holds a handful of rows.
    """
    by_k = W.partitionBy(F.lit(0)).orderBy("k")
    drop = F.lag("inertia").over(by_k) - F.col("inertia")
    following = F.col("inertia") - F.lead("inertia").over(by_k)
    rated = sweep.select("k", F.try_divide(drop, following).alias("ratio"))
    return rated.agg(F.coalesce(F.min(F.when(F.col("ratio") < limit, F.col("k"))), F.lit(2)).alias("k"))


def kmeans_clusters(vectors: DataFrame, k: int, model: KMeansModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and ``(cluster, size, centre, inertia)`` of the final model, fitted here unless it is given."""
    model = model or KMeans(k=k, seed=SEED, maxIter=MAX_ITERATIONS).fit(vectors)
    labelled = model.transform(vectors).withColumnRenamed("prediction", "cluster")
    centres = vectors.sparkSession.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>"
    )
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    summary = centres.join(sizes, "cluster", "left").select(
        "cluster",
        F.coalesce("size", F.lit(0)).alias("size"),
        "centre",
        F.lit(float(model.summary.trainingCost)).alias("inertia"),
    )
    return labelled, summary


def _squared_distance(a: Sequence[Column], centre: Column) -> Column:
    parts = [(x - centre[i]) * (x - centre[i]) for i, x in enumerate(a)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def nearest_centre(df: DataFrame, columns: Sequence[str], centres: DataFrame) -> DataFrame:
    """Add ``cluster`` and ``distance2`` of the nearest of the given ``(cluster, centre)`` rows.

    The centres, a model's, enter the scan as one array, so the rows are not joined.
    """
    known = centres.agg(F.collect_list(F.struct("cluster", "centre"))).scalar()
    point = [clean_double(c) for c in columns]
    best = F.array_min(
        F.transform(
            "_known", lambda c: F.struct(_squared_distance(point, c["centre"]).alias("d"), c["cluster"].alias("c"))
        )
    )
    complete = df.na.drop(subset=list(columns)).withColumn("_known", known).withColumn("_best", best)
    return complete.select(*df.columns, F.col("_best.c").alias("cluster"), F.col("_best.d").alias("distance2"))


def inertia_by_cluster(labelled: DataFrame) -> DataFrame:
    """``(cluster, size, inertia)`` of rows labelled by :func:`nearest_centre`."""
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("distance2").alias("inertia"))


def slice_sweep(df: DataFrame, columns: Sequence[str], along: str, largest: int = 10) -> DataFrame:
    """``(k, inertia)`` when the range of ``along`` is cut into k equal slices with their means as centres.

    A reproducible counterpart of the k-means sweep, from one scan for all k.
    """
    x = clean_double(along)
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    share = F.coalesce(F.try_divide(x - span["lo"], span["hi"] - span["lo"]), F.lit(0.0))
    slices = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.least(F.floor(share * k), F.lit(k - 1)).alias("slice"))
                for k in range(2, largest + 1)
            ]
        )
    )
    cells = (
        df.na.drop(subset=list({*columns, along}))
        .withColumn("_s", slices)
        .groupBy("_s.k", "_s.slice")
        .agg(*[(F.var_pop(clean_double(c)) * F.count(F.lit(1))).alias(f"v{i}") for i, c in enumerate(columns)])
    )
    within = sum((F.col(f"v{i}") for i in range(len(columns))), F.lit(0.0))
    return cells.groupBy("k").agg(F.sum(within).alias("inertia"))


def principal_components(vectors: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Projected rows, and ``(component, explained_variance_ratio, weights)``.

    The input is centred already (see :func:`scaled_vectors`), which Spark's transform requires.
    """
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(vectors)
    projected = model.transform(vectors).withColumn("_p", vector_to_array("_pca"))
    projected = projected.withColumns({f"pc{i + 1}": F.col("_p")[i] for i in range(k)}).drop("_pca", "_p")
    weights = model.pc.toArray()
    rows = [
        (i + 1, float(model.explainedVariance[i]), [float(v) for v in weights[:, i]]) for i in range(k)
    ]
    table = vectors.sparkSession.createDataFrame(
        rows, "component int, explained_variance_ratio double, weights array<double>"
    )
    return projected, table
