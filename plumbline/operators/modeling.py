"""Target choice, feature preparation, supervised models and their comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.functions.parts import spread
from plumbline.functions.scratch import materialize
from plumbline.operators.boosting import DEPTH6, LEAVES31, Boosting
from plumbline.operators.clean import impute_mean, one_hot_columns, standardize
from plumbline.operators.kernel_svm import KernelSVC
from plumbline.operators.metrics import classification_metrics, regression_metrics

SEED = 42
# Endings of column names that mark a likely target.
TARGET_ENDINGS = ("price", "cost", "value", "amount")


# ---------------------------------------------------------------- choices


def choose_target(columns: Sequence[str], numeric: Sequence[str]) -> str | None:
    """Only numeric column; else ``target``; else the first with a price-like name; else the last numeric."""
    if len(numeric) == 1:
        return numeric[0]
    if "target" in columns:
        return "target"
    priced = [c for c in numeric if c.lower().endswith(TARGET_ENDINGS)]
    return (priced or list(numeric[-1:]) or [None])[0]


def problem_type(df: DataFrame, target: str, max_classes: int = 10) -> DataFrame:
    """``(target, distinct_values, problem, problem_by_count)`` for a target column.

    ``problem`` follows the type: numeric is regression, few classes are classification, the rest is
    clustering. ``problem_by_count`` calls any target below ten distinct values a classification.
    """
    numeric = isinstance(df.schema[target].dataType, (T.NumericType, T.BooleanType))
    few = F.col("distinct_values") <= max_classes
    by_type = F.lit("regression") if numeric else F.when(few, "classification").otherwise("clustering")
    return df.agg(F.count_distinct(F.col(target)).alias("distinct_values")).select(
        F.lit(target).alias("target"),
        "distinct_values",
        by_type.alias("problem"),
        F.when(F.col("distinct_values") < max_classes, "classification")
        .otherwise("regression")
        .alias("problem_by_count"),
    )


def modeling_status(df: DataFrame, target: str | None, numeric: Sequence[str], least_rows: int = 20) -> DataFrame:
    """``(status, message, n)``: whether the table can be modelled, as a row instead of an exception."""
    too_few = F.col("n") < least_rows
    status = F.when(too_few, "insufficient_data")
    message = F.when(too_few, f"Need at least {least_rows} samples")
    if not numeric:
        status, message = status.otherwise("no_numeric_data"), message.otherwise("No numeric columns available")
    elif target not in df.columns:
        status, message = status.otherwise("invalid_target"), message.otherwise(f"Column {target} not found")
    else:
        status, message = status.otherwise("ok"), message.otherwise("Ready for modelling")
    return df.agg(F.count(F.lit(1)).alias("n")).select(status.alias("status"), message.alias("message"), "n")


def hash_split(df: DataFrame, key: Sequence[str], test_pct: int = 20) -> DataFrame:
    """Add ``part`` by a hash of the key: the same row always falls into the same part."""
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(100))
    return df.withColumn("part", F.when(bucket < test_pct, "test").otherwise("train"))


# ---------------------------------------------------------------- features


@dataclass(frozen=True)
class Prepared:
    """Rows with ``features``, ``label``, the names of the vector's entries and the columns left out as too wide."""

    rows: DataFrame
    names: list[str]
    classes: list[str] | None = None
    left_out: tuple[str, ...] = ()


def prepare(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    max_categories: int = 20,
    scale: bool = False,
    keep: Sequence[str] = (),
    classification: bool = False,
) -> Prepared:
    """Impute with means, add 0/1 columns for categoricals, assemble the feature vector.

    Columns with more than ``max_categories`` values are named in ``left_out``; a higher limit takes them in.
    Without numeric features the 0/1 columns alone form the vector; with none at all it is an error.
    """
    features = [c for c in numeric if c != target]
    base = impute_mean(df, features)
    used = [c for c in categorical if c != target]
    wide = one_hot_columns(base, used, max_categories) if used else base
    added = [c for c in wide.columns if c not in base.columns]
    left_out = tuple(c for c in used if not any(a.startswith(f"{c}_") for a in added))
    names = features + added
    if not names:
        raise ValueError("no usable feature columns")
    if scale:
        wide = standardize(wide, names, "_std")
        inputs = [f"{c}_std" for c in names]
    else:
        inputs = names
    classes = None
    if classification:
        wide = wide.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("string"))
        indexer = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(wide)
        wide = indexer.transform(wide).withColumn("label", F.col("_label"))
        classes = list(indexer.labels)
    else:
        wide = impute_mean(wide, [target]).withColumn("label", F.col(target).cast("double"))
    vectors = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip").transform(wide)
    return Prepared(vectors.select(*keep, "features", "label"), names, classes, left_out)


# ---------------------------------------------------------------- models


REGRESSIONS = (
    "linear", "ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting",
    "boosted_depth6", "boosted_leaves31", "second_order_depth6", "second_order_leaves31",
)


def regression_models(train: DataFrame, boosting_rounds: int = 100) -> dict[str, Estimator | Boosting]:
    """The regressors with penalties expressed in Spark's objective, which scales the label."""
    n, spread = train.agg(F.count("label"), F.stddev_pop("label")).first()
    spread = spread or 1.0
    plain = {"standardization": False, "maxIter": 200, "tol": 1e-9}
    ridge_alpha, lasso_alpha, net_alpha, net_ratio = 1.0, 0.1, 1.0, 0.5
    sample_spread = spread * (n / max(n - 1, 1)) ** 0.5
    l1, l2 = net_alpha * net_ratio, net_alpha * (1 - net_ratio) * sample_spread
    return {
        "linear": LinearRegression(regParam=0.0, solver="normal"),
        "ridge": LinearRegression(
            regParam=ridge_alpha * spread / n, elasticNetParam=0.0, solver="normal", standardization=False
        ),
        "lasso": LinearRegression(regParam=lasso_alpha, elasticNetParam=1.0, solver="l-bfgs", **plain),
        "elastic_net": LinearRegression(regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), solver="l-bfgs", **plain),
        "random_forest": RandomForestRegressor(numTrees=100, maxDepth=8, seed=SEED),
        "gradient_boosting": GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED),
        "boosted_depth6": GBTRegressor(maxIter=100, stepSize=0.3, maxDepth=6, seed=SEED),
        "boosted_leaves31": GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=5, seed=SEED),
        "second_order_depth6": Boosting(rounds=boosting_rounds, **DEPTH6),
        "second_order_leaves31": Boosting(rounds=boosting_rounds, **LEAVES31),
    }


def classification_models(train: DataFrame, classes: int, boosting_rounds: int = 100) -> dict[str, Estimator | Boosting | KernelSVC]:
    """The classifiers; first-order boosting and the linear SVM are binary and are wrapped one-vs-rest otherwise.

    The kernel machine is for two classes only.
    """
    n = max(train.count(), 1)
    loss = {"objective": "logistic" if classes <= 2 else "softmax", "classes": classes, "rounds": boosting_rounds}
    wrap = (lambda m: m) if classes <= 2 else (lambda m: OneVsRest(classifier=m, parallelism=4))
    kernel = {"kernel_svm": KernelSVC()} if classes <= 2 else {}
    return {
        "logistic": LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200),
        "random_forest": RandomForestClassifier(numTrees=100, maxDepth=8, seed=SEED),
        "gradient_boosting": wrap(GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED)),
        "linear_svm": wrap(LinearSVC(maxIter=100, regParam=1.0 / n)),
        "boosted_depth6": wrap(GBTClassifier(maxIter=100, stepSize=0.3, maxDepth=6, seed=SEED)),
        "boosted_leaves31": wrap(GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=5, seed=SEED)),
        "second_order_depth6": Boosting(**DEPTH6, **loss),
        "second_order_leaves31": Boosting(**LEAVES31, **loss),
        **kernel,
    }


@dataclass(frozen=True)
class Comparison:
    """Fitted models with their test metrics ``(model, metric, value)`` and test predictions."""

    models: Mapping[str, Model]
    metrics: DataFrame
    predictions: DataFrame


def compare(
    prepared: Prepared, split_key: Sequence[str], problem: str, only: Sequence[str] | None = None, boosting_rounds: int = 100
) -> Comparison:
    """Fit every model on the training part and measure all of them on the test part."""
    rows = materialize(spread(hash_split(prepared.rows, split_key)))
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    if problem == "regression":
        estimators = regression_models(train, boosting_rounds)
    else:
        estimators = classification_models(train, len(prepared.classes or []), boosting_rounds)
    chosen = {name: e for name, e in estimators.items() if only is None or name in only}
    fitted = {name: e.fit(train) for name, e in chosen.items()}
    parts = None
    for position, (name, model) in enumerate(fitted.items()):
        piece = model.transform(test)
        score = F.lit(None).cast("double")
        if problem != "regression" and len(prepared.classes or []) == 2:
            scores = "probability" if "probability" in piece.columns else "rawPrediction"
            is_array = isinstance(piece.schema[scores].dataType, T.ArrayType)
            score = (F.col(scores) if is_array else vector_to_array(scores))[1]
        piece = piece.select(
            F.lit(name).alias("model"),
            F.lit(position).alias("model_position"),
            *split_key,
            "label",
            "prediction",
            score.alias("score"),
            (F.col("label") - F.col("prediction")).alias("residual"),
        )
        parts = piece if parts is None else parts.unionByName(piece)
    measure = regression_metrics if problem == "regression" else classification_metrics
    averaging = {} if problem == "regression" else {"binary": len(prepared.classes or []) == 2}
    wide = measure(parts, "label", "prediction", ["model", "model_position"], **averaging)
    names = [c for c in wide.columns if c not in ("model", "model_position")]
    long = wide.unpivot(["model", "model_position"], names, "metric", "value")
    return Comparison(fitted, long, parts)


def best_model(metrics: DataFrame, metric: str) -> DataFrame:
    """The model with the highest value of a metric; the earlier one wins a tie."""
    order = F.struct(F.col("value"), -F.col("model_position"))
    return metrics.where(F.col("metric") == metric).groupBy("metric").agg(
        F.max_by("model", order).alias("model"), F.max("value").alias("value")
    )


def cross_validation(prepared: Prepared, estimator: Estimator, key: Sequence[str], problem: str, folds: int = 5) -> DataFrame:
    """``(metric, mean, std, folds)`` over hash folds, so the folds do not depend on the partitioning."""
    fold = F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(folds)).cast("int")
    rows = materialize(spread(prepared.rows.withColumn("fold", fold)))
    if problem == "regression":
        evaluator, metric = RegressionEvaluator(metricName="r2"), "r2"
    else:
        evaluator, metric = MulticlassClassificationEvaluator(metricName="f1"), "f1"
    model = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        seed=SEED,
    ).fit(rows)
    return rows.sparkSession.createDataFrame(
        [(metric, float(model.avgMetrics[0]), float(model.stdMetrics[0]), folds)],
        "metric string, mean double, std double, folds int",
    )


def _scores(model: Model) -> list[float] | None:
    """Importance of each feature: tree gains, or absolute coefficients averaged over the classes."""
    if hasattr(model, "gains"):
        return model.gains
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if getattr(model, "numClasses", 2) > 2 and hasattr(model, "coefficientMatrix"):
        return [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    if hasattr(model, "coefficients"):
        return [float(abs(v)) for v in model.coefficients.toArray()]
    if hasattr(model, "models"):
        parts = [p for p in (_scores(m) for m in model.models) if p]
        return [sum(values) / len(values) for values in zip(*parts)] if parts else None
    return None


def importance_table(spark, models: Mapping[str, Model], names: Sequence[str]) -> DataFrame:
    """``(method, feature, score, rank)`` of fitted models; one row per feature and model."""
    rows = []
    for method, model in models.items():
        scores = _scores(model) or []
        ranked = sorted(zip(names, scores), key=lambda pair: (-pair[1], pair[0]))
        rows += [(method, feature, score, rank) for rank, (feature, score) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "method string, feature string, score double, rank int")


def two_method_importance(prepared: Prepared, problem: str) -> DataFrame:
    """Random-forest and boosting importances fitted on all rows."""
    rows = materialize(spread(prepared.rows))
    if problem == "regression":
        pair = {
            "random_forest": RandomForestRegressor(numTrees=100, maxDepth=8, seed=SEED),
            "boosting": GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED),
        }
    else:
        booster = GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED)
        pair = {
            "random_forest": RandomForestClassifier(numTrees=100, maxDepth=8, seed=SEED),
            "boosting": booster if len(prepared.classes or []) <= 2 else OneVsRest(classifier=booster, parallelism=4),
        }
    return importance_table(rows.sparkSession, {m: e.fit(rows) for m, e in pair.items()}, prepared.names)


def simple_regressions(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(model, model_position, metric, value)``: slope, intercept and r2 of one-feature least squares, in one scan."""
    y = F.col(target).cast("double")
    row = df.agg(
        *[
            F.struct(
                F.regr_slope(y, F.col(f).cast("double")).alias("slope"),
                F.regr_intercept(y, F.col(f).cast("double")).alias("intercept"),
                F.regr_r2(y, F.col(f).cast("double")).alias("r2"),
            ).alias(f"f{i}")
            for i, f in enumerate(features)
        ]
    )
    cells = [
        F.struct(
            F.lit(f).alias("model"), F.lit(i).alias("model_position"), F.lit(m).alias("metric"), F.col(f"f{i}")[m].alias("value")
        )
        for i, f in enumerate(features)
        for m in ("slope", "intercept", "r2")
    ]
    return row.select(F.inline(F.array(*cells)))
