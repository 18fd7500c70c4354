"""Queries on models, their quality and clusters."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from plumbline.functions.scratch import materialize
from plumbline.operators import boosting, cluster, density, kernel_svm, metrics, modeling
from plumbline.plans.registry import query, rounded, union_all
from plumbline.plans.views import embedding_columns, table, text_features

# ---------------------------------------------------------------- choices and preparation


@query(
    union_all(
        [
            f"SELECT '{c}' AS target, count(DISTINCT {c}) AS distinct_values, {p} AS problem, "
            f"CASE WHEN count(DISTINCT {c}) < 10 THEN 'classification' ELSE 'regression' END AS problem_by_count FROM part"
            for c, p in [
                ("p_retailprice", "'regression'"),
                ("p_type", "CASE WHEN count(DISTINCT p_type) <= 10 THEN 'classification' ELSE 'clustering' END"),
                ("p_name", "CASE WHEN count(DISTINCT p_name) <= 10 THEN 'classification' ELSE 'clustering' END"),
            ]
        ]
    )
)
def problem_type(spark, d):
    p = table(spark, d, "part")
    parts = [modeling.problem_type(p, c) for c in ("p_retailprice", "p_type", "p_name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """SELECT 'part' AS source, CASE WHEN count(*) < 20 THEN 'insufficient_data' ELSE 'ok' END AS status,
      CASE WHEN count(*) < 20 THEN 'Need at least 20 samples' ELSE 'Ready for modelling' END AS message, count(*) AS n FROM part
    UNION ALL SELECT 'region', CASE WHEN count(*) < 20 THEN 'insufficient_data' ELSE 'ok' END,
      CASE WHEN count(*) < 20 THEN 'Need at least 20 samples' ELSE 'Ready for modelling' END, count(*) FROM region
    UNION ALL SELECT 'orders', CASE WHEN count(*) < 20 THEN 'insufficient_data' ELSE 'invalid_target' END,
      CASE WHEN count(*) < 20 THEN 'Need at least 20 samples' ELSE 'Column target not found' END, count(*) FROM orders
    UNION ALL SELECT 'nation', CASE WHEN count(*) < 20 THEN 'insufficient_data' ELSE 'no_numeric_data' END,
      CASE WHEN count(*) < 20 THEN 'Need at least 20 samples' ELSE 'No numeric columns available' END, count(*) FROM nation"""
)
def modeling_status(spark, d):
    cases = [
        ("part", "p_retailprice", ["p_size", "p_retailprice"]),
        ("region", "r_regionkey", ["r_regionkey"]),
        ("orders", "target", ["o_totalprice"]),
        ("nation", None, []),
    ]
    result = None
    for name, target, numeric in cases:
        part = modeling.modeling_status(table(spark, d, name), target, numeric).withColumn("source", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


_PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]


def _part_regression(spark, d, scale=False):
    return modeling.prepare(
        table(spark, d, "part"), "p_retailprice", _PART_NUMERIC, ["p_type"], scale=scale, keep=["p_partkey"]
    )


@query(
    """SELECT p_partkey, p_partkey::DOUBLE AS f0, p_size::DOUBLE AS f1, (p_type = 'ECONOMY')::INT::DOUBLE AS f2,
      (p_type = 'LARGE')::INT::DOUBLE AS f3, (p_type = 'MEDIUM')::INT::DOUBLE AS f4, (p_type = 'PROMO')::INT::DOUBLE AS f5,
      (p_type = 'SMALL')::INT::DOUBLE AS f6, (p_type = 'STANDARD')::INT::DOUBLE AS f7, round(p_retailprice, 4) AS label FROM part"""
)
def feature_matrix(spark, d):
    prepared = _part_regression(spark, d)
    v = vector_to_array("features")
    wide = prepared.rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), *[v[i].alias(f"f{i}") for i in range(len(prepared.names))], "label")
    return rounded(wide)


@query()
def train_test_split(spark, d):
    split = modeling.hash_split(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- regression


@query(
    """SELECT f AS model, p AS model_position, m AS metric, round(v, 6) + 0.0 AS value FROM (
      SELECT 'l_quantity' AS f, 0 AS p, unnest(['slope', 'intercept', 'r2']) AS m,
        unnest([regr_slope(l_extendedprice, l_quantity), regr_intercept(l_extendedprice, l_quantity), regr_r2(l_extendedprice, l_quantity)]) AS v FROM lineitem
      UNION ALL SELECT 'l_discount', 1, unnest(['slope', 'intercept', 'r2']),
        unnest([regr_slope(l_extendedprice, l_discount), regr_intercept(l_extendedprice, l_discount), regr_r2(l_extendedprice, l_discount)]) FROM lineitem
      UNION ALL SELECT 'l_tax', 2, unnest(['slope', 'intercept', 'r2']),
        unnest([regr_slope(l_extendedprice, l_tax), regr_intercept(l_extendedprice, l_tax), regr_r2(l_extendedprice, l_tax)]) FROM lineitem)"""
)
def linear_regression_one_feature(spark, d):
    fits = modeling.simple_regressions(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(fits, 6).withColumn("model_position", F.col("model_position").cast("long"))


@query(
    """SELECT regr_slope(p_retailprice, p_size) IS NOT NULL AS fitted, round(regr_slope(p_retailprice, p_size), 5) + 0.0 AS slope,
      round(regr_intercept(p_retailprice, p_size), 5) AS intercept FROM part"""
)
def linear_regression_fit(spark, d):
    """The same line from the general solver, on a one-entry feature vector."""
    prepared = modeling.prepare(table(spark, d, "part"), "p_retailprice", ["p_size", "p_retailprice"])
    model = LinearRegression(regParam=0.0, solver="normal").fit(prepared.rows)
    # One row with the coefficients, attached to the table's own row count.
    return rounded(
        table(spark, d, "part").agg(F.count(F.lit(1)).alias("n")).select(
            (F.col("n") > 1).alias("fitted"),
            F.lit(float(model.coefficients[0])).alias("slope"),
            F.lit(float(model.intercept)).alias("intercept"),
        ),
        5,
    )


def _regression(spark, d, only):
    prepared = _part_regression(spark, d)
    return prepared, modeling.compare(prepared, ["p_partkey"], "regression", only)


@query()
def regularized_regressions(spark, d):
    """Linear, ridge, lasso and elastic-net regression of the retail price: test metrics."""
    return rounded(_regression(spark, d, ["linear", "ridge", "lasso", "elastic_net"])[1].metrics, 6)


@query()
def tree_regressions(spark, d):
    """Random forest and gradient boosting of the retail price: test metrics."""
    return rounded(_regression(spark, d, ["random_forest", "gradient_boosting"])[1].metrics, 6)


@query()
def boosted_regression_presets(spark, d):
    return rounded(_regression(spark, d, ["boosted_depth6", "boosted_leaves31"])[1].metrics, 6)


@query(
    """WITH v(feature, x, y) AS (SELECT 'p_size', p_size::DOUBLE, p_retailprice FROM part
      UNION ALL SELECT 'p_brand', substring(p_brand, 7)::DOUBLE, p_retailprice FROM part),
    c AS (SELECT feature, x, sum(y) AS s, count(*) AS n FROM v GROUP BY ALL),
    r AS (SELECT feature, x AS threshold, sum(s) OVER w AS gl, sum(n) OVER w AS nl, sum(s) OVER (PARTITION BY feature) AS g, sum(n) OVER (PARTITION BY feature) AS n
      FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)),
    d AS (SELECT feature, threshold, nl, n, gl - g / n * nl AS l, g / n AS mean FROM r WHERE nl < n),
    b AS (SELECT *, (l * l / (nl + 1) + l * l / (n - nl + 1)) / 2 AS gain FROM d ORDER BY gain DESC LIMIT 1)
    SELECT feature, threshold, round(gain, 2) AS gain, nl::BIGINT AS n_left, (n - nl)::BIGINT AS n_right,
      round(mean + 0.3 * l / (nl + 1), 4) AS low, round(mean - 0.3 * l / (n - nl + 1), 4) AS high FROM b"""
)
def second_order_first_split(spark, d):
    """One round of one level: the split with the largest gain over all values of two columns, and what its sides predict."""
    part = table(spark, d, "part").withColumn("brand", F.substring("p_brand", 7, 9).cast("double"))
    prepared = modeling.prepare(part, "p_retailprice", ["p_size", "brand", "p_retailprice"], keep=["p_size", "brand"])
    model = boosting.Boosting(rounds=1, max_depth=1).fit(prepared.rows)
    tree = model.rounds[0][0]
    name = prepared.names[tree.feature[0]]
    threshold = float(model.cuts[tree.feature[0]][tree.cut[0]])
    guessed = model.transform(prepared.rows)
    left = F.col(name) <= threshold
    found = guessed.agg(
        F.sum(left.cast("long")).alias("n_left"), F.sum((~left).cast("long")).alias("n_right"),
        F.max(F.when(left, F.col("prediction"))).alias("low"), F.max(F.when(~left, F.col("prediction"))).alias("high"),
    )
    named = {"p_size": "p_size", "brand": "p_brand"}[name]
    return rounded(found.select(F.lit(named).alias("feature"), F.lit(threshold).alias("threshold"), F.lit(tree.gain[0]).alias("gain"), "n_left", "n_right", "low", "high"), 4, gain=2)


@query()
def second_order_regression(spark, d):
    """Second-order boosting of the retail price, by level and by leaf, 3 rounds: test metrics."""
    prepared = _part_regression(spark, d)
    compared = modeling.compare(prepared, ["p_partkey"], "regression", ["second_order_depth6", "second_order_leaves31"], boosting_rounds=3)
    return rounded(compared.metrics, 4)


@query()
def second_order_multiclass(spark, d):
    """Ten embedding labels by softmax trees, ten trees a round, 2 rounds: test metrics."""
    vectors = embedding_columns(spark, d)
    features = [c for c in vectors.columns if c.startswith("e")]
    prepared = modeling.prepare(vectors, "label", features, keep=["vec_id"], classification=True)
    compared = modeling.compare(prepared, ["vec_id"], "classification", ["second_order_depth6"], boosting_rounds=2)
    return rounded(compared.metrics, 4)


@query()
def predictions_and_residuals(spark, d):
    compared = _regression(spark, d, ["linear"])[1]
    return rounded(compared.predictions.select(F.col("p_partkey").cast("long").alias("p_partkey"), "model", "label", "prediction", "residual"), 4)


@query(
    """WITH p AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS f FROM lineitem)
    SELECT round(avg(pow(y - f, 2)), 0) + 0.0 AS mse, round(sqrt(avg(pow(y - f, 2))), 4) AS rmse, round(avg(abs((y - f) / nullif(y, 0))) * 100, 4) AS mape,
      round(avg(abs(y - f)), 4) AS mae, round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(y)), 6) AS r2 FROM p"""
)
def regression_metrics(spark, d):
    guess = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return rounded(metrics.regression_metrics(guess, "l_extendedprice", "guess"), 4, r2=6, mse=0)


@query(
    """WITH m(model, r2) AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']), unnest([regr_r2(l_extendedprice, l_quantity),
      regr_r2(l_extendedprice, l_discount), regr_r2(l_extendedprice, l_tax)]) FROM lineitem)
    SELECT 'r2' AS metric, arg_max(model, r2) AS model, round(max(r2), 8) AS value FROM m"""
)
def best_model(spark, d):
    fits = modeling.simple_regressions(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(modeling.best_model(fits, "r2"), 8)


@query()
def regression_importance(spark, d):
    prepared, compared = _regression(spark, d, ["linear", "random_forest"])
    return rounded(modeling.importance_table(spark, compared.models, prepared.names), 6)


@query()
def two_method_importance(spark, d):
    return rounded(modeling.two_method_importance(_part_regression(spark, d), "regression"), 6)


@query()
def cross_validation(spark, d):
    prepared = _part_regression(spark, d, scale=True)
    return rounded(modeling.cross_validation(prepared, LinearRegression(solver="normal"), ["p_partkey"], "regression"), 6)


# ---------------------------------------------------------------- classification

_TEXT_FEATURES = ["n_chars", "n_words", "n_lines", "n_digits"]


def _quality_prepared(spark, d):
    # Means, spreads, classes and rows are taken from four short numbers a text; the texts are read once.
    return modeling.prepare(
        materialize(text_features(spark, d)), "quality", _TEXT_FEATURES, scale=True, keep=["doc_id"], classification=True
    )


def _classification(spark, d, only):
    prepared = _quality_prepared(spark, d)
    return prepared, modeling.compare(prepared, ["doc_id"], "classification", only)


@query()
def binary_classifiers(spark, d):
    """Logistic regression, random forest, boosting and linear SVM for document quality: test metrics."""
    only = ["logistic", "random_forest", "gradient_boosting", "linear_svm"]
    return rounded(_classification(spark, d, only)[1].metrics, 6)


@query()
def kernel_svm_classifier(spark, d):
    """Machine with a radial kernel and probabilities for document quality: test metrics."""
    return rounded(_classification(spark, d, ["kernel_svm"])[1].metrics, 4)


@query(
    """SELECT n, abs(gradient_a) < 0.02 AS slope_fits, abs(gradient_b) < 0.01 AS shift_fits, p_rises FROM (
      SELECT count(*) AS n, 0.0 AS gradient_a, 0.0 AS gradient_b, corr(n_chars, quality) > 0 AS p_rises FROM labels JOIN documents USING (doc_id))"""
)
def probability_calibration(spark, d):
    """The sigmoid from document length to quality: at its optimum the residuals sum to zero, with length and without."""
    rows = _length_score(spark, d).select((F.col("n_chars") / 1000.0).alias("m"), F.col("quality").alias("label"))
    slope, shift = kernel_svm.sigmoid(rows)
    p = 1 / (1 + F.exp(slope * F.col("m") + shift))
    ones = F.sum("label")
    counted = rows.crossJoin(rows.agg(((ones + 1) / (ones + 2)).alias("high"), (1 / (F.count(F.lit(1)) - ones + 2)).alias("low")))
    residual = F.when(F.col("label") == 1, F.col("high")).otherwise(F.col("low")) - p
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum(residual * F.col("m")).alias("a"), F.sum(residual).alias("b")).select(
        "n", (F.abs("a") < 0.02).alias("slope_fits"), (F.abs("b") < 0.01).alias("shift_fits"), F.lit(slope < 0).alias("p_rises")
    )


@query()
def boosted_classifier_presets(spark, d):
    return rounded(_classification(spark, d, ["boosted_depth6", "boosted_leaves31"])[1].metrics, 6)


@query()
def multiclass_classifiers(spark, d):
    """Ten embedding labels from 64 numbers: multinomial logistic regression and random forest."""
    vectors = embedding_columns(spark, d)
    features = [c for c in vectors.columns if c.startswith("e")]
    prepared = modeling.prepare(vectors, "label", features, keep=["vec_id"], classification=True)
    compared = modeling.compare(prepared, ["vec_id"], "classification", ["logistic", "random_forest"])
    return rounded(compared.metrics, 6)


@query()
def multiclass_boosting(spark, d):
    """Boosted trees one-vs-rest for the six part types."""
    parts = table(spark, d, "part")
    prepared = modeling.prepare(parts, "p_type", _PART_NUMERIC, keep=["p_partkey"], classification=True)
    return rounded(modeling.compare(prepared, ["p_partkey"], "classification", ["gradient_boosting"]).metrics, 6)


@query()
def classifier_importance(spark, d):
    prepared, compared = _classification(spark, d, ["logistic", "random_forest"])
    return rounded(modeling.importance_table(spark, compared.models, prepared.names), 6)


@query()
def classifier_roc(spark, d):
    """ROC points of the logistic model on the test documents."""
    compared = _classification(spark, d, ["logistic"])[1]
    return rounded(metrics.roc_curve(compared.predictions, "label", "score", 1.0), 6)


_RULE = "SELECT quality AS a, (n_chars > 1500)::INT AS p FROM labels JOIN documents USING (doc_id)"


def _rule(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("guess"))
    return table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")


@query(
    f"""WITH r AS ({_RULE}), c AS (SELECT count(*) AS n, count(*) FILTER (a = p) AS ok, count(*) FILTER (a = 1 AND p = 1) AS tp,
      count(*) FILTER (p = 1) AS pp, count(*) FILTER (a = 1) AS ap FROM r),
    v AS (SELECT ok / n AS accuracy, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(ap, 0), 0) AS recall FROM c)
    SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM v"""
)
def classification_metrics_binary(spark, d):
    return rounded(metrics.classification_metrics(_rule(spark, d), "quality", "guess", binary=True), 6)


_CLASS_RULE = "SELECT p_type AS a, CASE WHEN p_size > 25 THEN 'LARGE' WHEN p_size > 12 THEN 'MEDIUM' ELSE 'SMALL' END AS p FROM part"


def _class_rule(spark, d):
    size = F.col("p_size")
    guess = F.when(size > 25, "LARGE").when(size > 12, "MEDIUM").otherwise("SMALL")
    return table(spark, d, "part").select("p_type", guess.alias("guess"))


@query(
    f"""WITH r AS ({_CLASS_RULE}), c AS (SELECT c, (SELECT count(*) FROM r WHERE a = c) AS n, (SELECT count(*) FROM r WHERE p = c) AS np,
      (SELECT count(*) FROM r WHERE a = c AND p = c) AS tp FROM (SELECT DISTINCT a AS c FROM r)),
    v AS (SELECT n, coalesce(tp / nullif(np, 0), 0) AS pr, tp / n AS re, tp FROM c)
    SELECT round(sum(tp) / sum(n), 6) AS accuracy, round(sum(pr * n) / sum(n), 6) AS precision, round(sum(re * n) / sum(n), 6) AS recall,
      round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * n) / sum(n), 6) AS f1 FROM v"""
)
def classification_metrics_weighted(spark, d):
    return rounded(metrics.classification_metrics(_class_rule(spark, d), "p_type", "guess"), 6)


@query(
    f"""WITH r AS ({_CLASS_RULE}), k AS (SELECT a AS c FROM r UNION SELECT p FROM r), n AS (SELECT a, p, count(*) AS n FROM r GROUP BY ALL)
    SELECT x.c AS actual, y.c AS predicted, coalesce(n, 0) AS n FROM k x CROSS JOIN k y LEFT JOIN n ON n.a = x.c AND n.p = y.c"""
)
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_class_rule(spark, d), "p_type", "guess")


_ROC_SQL = """r AS (SELECT quality AS y, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id)),
g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY 1),
c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g)"""


def _length_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")


@query(
    f"""WITH {_ROC_SQL} SELECT s AS threshold, round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr,
    round(neg / an * (2 * tp - pos) / (2 * ap), 8) AS area FROM c"""
)
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(_length_score(spark, d), "quality", "n_chars"), 6, area=8)


@query(
    """WITH r AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)),
    k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM r)
    SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc,
      (SELECT count(DISTINCT s) FROM r) AS thresholds FROM k"""
)
def area_under_roc(spark, d):
    return rounded(metrics.auc(_length_score(spark, d), "quality", "n_chars"), 6)


@query()
def model_comparison(spark, d):
    """Metrics of every problem type side by side."""
    parts = [
        _regression(spark, d, ["linear", "ridge"])[1].metrics.withColumn("problem", F.lit("regression")),
        _classification(spark, d, ["logistic", "random_forest"])[1].metrics.withColumn("problem", F.lit("classification")),
    ]
    return rounded(parts[0].unionByName(parts[1]), 6)


# ---------------------------------------------------------------- clustering

_PART_POINTS = ["p_size", "p_retailprice"]


@query()
def kmeans_sweep(spark, d):
    return rounded(cluster.kmeans_sweep(cluster.scaled_vectors(table(spark, d, "part"), _PART_POINTS)), 4)


@query()
def kmeans_clusters(spark, d):
    """Size, centre and inertia for the k with the best silhouette."""
    vectors = cluster.scaled_vectors(table(spark, d, "part"), _PART_POINTS)
    models = {}
    k = cluster.k_by_silhouette(cluster.kmeans_sweep(vectors, models=models)).first()["k"]
    summary = cluster.kmeans_clusters(vectors, k, models[k])[1]
    return rounded(summary.withColumn("centre", F.concat_ws(",", F.transform("centre", lambda v: F.round(v, 4).cast("string")))))


_SLICE_SQL = """s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
p AS (SELECT k, least(floor((p_retailprice - lo) / (hi - lo) * k), k - 1) AS s, p_size AS x, p_retailprice AS y FROM part, s, (SELECT unnest(range(2, 11)) AS k)),
v AS (SELECT k, s, var_pop(x) * count(*) + var_pop(y) * count(*) AS v FROM p GROUP BY ALL),
sweep AS (SELECT k, sum(v) AS inertia FROM v GROUP BY 1)"""


@query(f"WITH {_SLICE_SQL} SELECT k, round(inertia, 2) AS inertia FROM sweep")
def slice_sweep(spark, d):
    return rounded(cluster.slice_sweep(table(spark, d, "part"), _PART_POINTS, "p_retailprice"), 2)


@query(
    f"""WITH {_SLICE_SQL}, r AS (SELECT k, (lag(inertia) OVER (ORDER BY k) - inertia) / nullif(inertia - lead(inertia) OVER (ORDER BY k), 0) AS r FROM sweep)
    SELECT coalesce(min(k) FILTER (r < 0.3), 2) AS k FROM r"""
)
def k_by_ratio(spark, d):
    sweep = cluster.slice_sweep(table(spark, d, "part"), _PART_POINTS, "p_retailprice")
    return rounded(cluster.k_by_ratio(sweep))


@query(f"WITH {_SLICE_SQL} SELECT arg_max(k, -inertia) AS k FROM sweep")
def k_by_score(spark, d):
    """The silhouette chooser on a reproducible score (less inertia is better)."""
    sweep = cluster.slice_sweep(table(spark, d, "part"), _PART_POINTS, "p_retailprice")
    return rounded(cluster.k_by_silhouette(sweep.withColumn("silhouette", -F.col("inertia"))))


_CENTRES_SQL = """c AS (SELECT dense_rank() OVER (ORDER BY p_type) - 1 AS cluster, avg(p_size) AS cx, avg(p_retailprice) AS cy FROM part GROUP BY p_type),
n AS (SELECT p_partkey, arg_min(cluster, (pow(p_size - cx, 2) + pow(p_retailprice - cy, 2), cluster)) AS cluster,
  min(pow(p_size - cx, 2) + pow(p_retailprice - cy, 2)) AS d FROM part CROSS JOIN c GROUP BY 1)"""


def _type_centres(spark, d):
    """Mean size and price of every part type as given centres."""
    from plumbline.operators.clean import label_codes

    p = table(spark, d, "part")
    codes = label_codes(p, ["p_type"]).select(F.col("value").alias("p_type"), F.col("code").alias("cluster"))
    means = p.groupBy("p_type").agg(F.array(F.avg("p_size"), F.avg("p_retailprice")).alias("centre"))
    return means.join(codes, "p_type").select("cluster", "centre")


@query(f"WITH {_CENTRES_SQL} SELECT p_partkey, cluster, round(d, 3) AS distance2 FROM n")
def nearest_centre(spark, d):
    labelled = cluster.nearest_centre(table(spark, d, "part"), _PART_POINTS, _type_centres(spark, d))
    return rounded(labelled.select("p_partkey", "cluster", "distance2"), 3)


@query(f"WITH {_CENTRES_SQL} SELECT cluster, count(*) AS size, round(sum(d), 2) AS inertia FROM n GROUP BY 1")
def inertia_by_cluster(spark, d):
    labelled = cluster.nearest_centre(table(spark, d, "part"), _PART_POINTS, _type_centres(spark, d))
    return rounded(cluster.inertia_by_cluster(labelled), 2)


def _embedding_vectors(spark, d):
    vectors = embedding_columns(spark, d)
    return cluster.scaled_vectors(vectors, [c for c in vectors.columns if c.startswith("e")], ["vec_id"])


@query()
def principal_components(spark, d):
    """Explained share of the first two components of the embeddings."""
    table_of_components = cluster.principal_components(_embedding_vectors(spark, d))[1]
    return rounded(table_of_components.select("component", "explained_variance_ratio"), 6)


@query()
def projected_rows(spark, d):
    projected = cluster.principal_components(_embedding_vectors(spark, d))[0]
    # The sign of a component is free, so it is fixed by its absolute value here.
    return rounded(projected.select("vec_id", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2")), 4)


_SCALED_SQL = """s AS (SELECT p_partkey AS id, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x,
  (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS y FROM part),
deg AS (SELECT a.id, count(*) AS n FROM s a JOIN s b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {eps} * {eps} GROUP BY 1)"""


def _scaled_parts(spark, d):
    from plumbline.operators.clean import standardize

    return standardize(table(spark, d, "part"), _PART_POINTS, "_z").select("p_partkey", "p_size_z", "p_retailprice_z")


_POINTS = ["p_size_z", "p_retailprice_z"]
_TIGHT = 0.06


@query(
    f"""WITH {_SCALED_SQL.format(eps=_TIGHT)}, core AS (SELECT s.* FROM s JOIN deg USING (id) WHERE n >= 5),
    near AS (SELECT DISTINCT a.id FROM s a JOIN core b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {_TIGHT} * {_TIGHT})
    SELECT id AS p_partkey, id IN (SELECT id FROM core) AS is_core, id NOT IN (SELECT id FROM near) AS is_noise FROM s"""
)
def density_roles(spark, d):
    """Core, border and noise points of parts in the plane of scaled size and price."""
    labelled = density.dbscan(_scaled_parts(spark, d), "p_partkey", _POINTS, eps=_TIGHT, min_samples=5)
    return labelled.select("p_partkey", "is_core", (F.col("cluster") == -1).alias("is_noise"))


@query(
    f"""WITH {_SCALED_SQL.format(eps=0.5)}, core AS (SELECT s.* FROM s JOIN deg USING (id) WHERE n >= 5),
    near AS (SELECT DISTINCT a.id FROM s a JOIN core b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.25)
    SELECT (SELECT count(*) FROM s) AS points, (SELECT count(*) FROM core) AS core_points,
      (SELECT count(*) FROM s) - (SELECT count(*) FROM near) AS noise"""
)
def density_summary(spark, d):
    """Default radius and neighbour count."""
    labelled = density.dbscan(_scaled_parts(spark, d), "p_partkey", _POINTS)
    return density.dbscan_summary(labelled).select("points", "core_points", "noise")


@query()
def density_clusters(spark, d):
    """Cluster sizes of the density clustering with a tight radius."""
    labelled = density.dbscan(_scaled_parts(spark, d), "p_partkey", _POINTS, eps=_TIGHT, min_samples=5)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def density_silhouette(spark, d):
    points = _scaled_parts(spark, d)
    labelled = density.dbscan(points, "p_partkey", _POINTS, eps=_TIGHT, min_samples=5)
    return rounded(density.silhouette_without_noise(points, labelled, "p_partkey", _POINTS), 4)
