"""One-call drivers: which analyses run on a table, depending on its column roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.scratch import materialize
from plumbline.operators import (
    associate,
    business,
    changepoints,
    clean,
    cluster,
    density,
    describe,
    forecast,
    modeling,
    quality,
    report,
    schema,
    timeseries as ts,
)
from plumbline.sources.readers import read_table
from plumbline.sources.writers import write_parquet

MODES = ("minimal", "auto", "comprehensive")


def _model_results(
    df: DataFrame, roles: schema.RoleMap, key: Sequence[str], comprehensive: bool
) -> dict[str, DataFrame]:
    target = modeling.choose_target(df.columns, roles.numeric)
    out = {"modeling_status": modeling.modeling_status(df, target, roles.numeric)}
    if out["modeling_status"].first()["status"] != "ok" or len(roles.numeric) < 2:
        return out
    features = [c for c in roles.numeric if c not in key]
    if target not in features or len(features) < 2:
        return out
    prepared = modeling.prepare(df, target, features, roles.categorical, keep=key)
    # Boosting of second order takes a scan for every level of every tree, so it is left to the longest mode.
    short = [n for n in modeling.REGRESSIONS if not n.startswith("second_order")]
    compared = modeling.compare(prepared, key, "regression", None if comprehensive else short, boosting_rounds=20)
    out["model_metrics"] = compared.metrics
    if prepared.left_out:
        reasons = [(c, "too many categories") for c in prepared.left_out]
        out["left_out_columns"] = df.sparkSession.createDataFrame(reasons, "column string, reason string")
    out["best_model"] = modeling.best_model(compared.metrics, "r2")
    out["feature_importance"] = modeling.importance_table(df.sparkSession, compared.models, prepared.names)
    if comprehensive:
        vectors = cluster.scaled_vectors(df, features, key)
        models = {}
        sweep = cluster.kmeans_sweep(vectors, models=models)
        k = cluster.k_by_silhouette(sweep).first()["k"]
        out["cluster_sweep"] = sweep
        out["clusters"] = cluster.kmeans_clusters(vectors, k, models.get(k))[1]
        if len(features) > 2:
            out["components"] = cluster.principal_components(vectors)[1]
        if len(key) == 1:
            scaled = clean.standardize(clean.impute_mean(df, features), features, "")
            out["density_clusters"] = density.dbscan_summary(density.dbscan(scaled, key[0], features))
    return out


def analyze(
    df: DataFrame, key: Sequence[str], mode: str = "auto", roles: schema.RoleMap | None = None
) -> dict[str, DataFrame]:
    """Named result tables. ``minimal``: statistics only; ``auto`` adds models, date columns,
    correlations and categories; ``comprehensive`` adds clustering and forecasts. The tables of the second
    date column and of later ones have the column's name behind theirs, as ``daily_counts:shipped``.

    ``key`` identifies a row; it breaks ties and splits training from test rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    roles = roles or schema.classify(df)
    df = schema.apply_roles(df, roles)
    numeric = list(roles.numeric)
    results = {"dtypes": schema.dtype_profile(df), "missing": quality.missing_summary(df)}
    if numeric:
        results["numeric"] = describe.numeric_describe(df, numeric)
    if mode == "minimal":
        return results
    results |= _model_results(df, roles, key, mode == "comprehensive")
    for place, date in enumerate(roles.datetime):
        mark = f":{date}" if place else ""
        results[f"daily_counts{mark}"] = ts.daily_counts(df, date)
        results[f"monthly_counts{mark}"] = ts.monthly_counts(df, date)
        results[f"date_range{mark}"] = ts.date_range(df, date)
        if mode == "comprehensive":
            for value in [c for c in numeric if c not in key]:
                monthly = materialize(ts.daily_series(df, date, value, grain="month"))
                results[f"smoothing_forecast{mark}:{value}"] = forecast.holt_winters_forecast(monthly)
                results[f"seasonal_forecast{mark}:{value}"] = forecast.trend_season_forecast(monthly)
                results[f"change_point_forecast{mark}:{value}"] = changepoints.change_point_forecast(monthly)
    if len(numeric) > 1:
        results["correlations"] = associate.significant_pair_map(df, numeric)
    if roles.categorical:
        results["categories"] = describe.top_categories(df, roles.categorical)
    return results


def full_report(
    df: DataFrame, source: str, tie: Sequence[str], roles: schema.RoleMap | None = None, digits: int | None = None
) -> DataFrame:
    """The report table: quality, statistics, correlations, normality, time coverage, forecasts, advice."""
    roles = roles or schema.classify(df)
    df = schema.apply_roles(df, roles)
    numeric, categorical, dates = list(roles.numeric), list(roles.categorical), list(roles.datetime)
    facts = [
        report.as_facts("metadata", report.run_metadata(df, source, with_time=False), ["source"], digits),
        report.as_facts("quality", quality.quality_score(df), (), digits),
        report.as_facts("quality_issues", quality.quality_issues(df), ["issue_type", "column"], digits),
    ]
    if numeric:
        facts.append(report.as_facts("statistics", describe.numeric_describe(df, numeric, True), ["column"], digits))
        facts.append(report.as_facts("normality", associate.jarque_bera(df, numeric), ["column"], digits))
    if len(numeric) > 1:
        pairs = associate.significant_pairs(df, numeric)
        facts.append(report.as_facts("correlations", pairs, ["feature1", "feature2"], digits))
    if categorical:
        facts.append(report.as_facts("categories", describe.categorical_summary(df, categorical), ["column"], digits))
    for date in dates:
        facts.append(report.as_facts(f"coverage:{date}", ts.date_range(df, date), (), digits))
        facts.append(report.as_facts(f"frequency:{date}", ts.frequency_label(df, date, tie=tie), (), digits))
        facts.append(report.as_facts(f"horizon:{date}", ts.forecast_horizon(df, date), (), digits))
        for value in numeric:
            if value in tie:
                continue
            name = f"{date}:{value}"
            facts.append(report.as_facts(f"changes:{name}", ts.change_metrics(df, date, value, tie=tie), (), digits))
            facts.append(report.as_facts(f"readiness:{name}", ts.forecast_readiness(df, date, value), (), digits))
            limits = ts.forecast_limitations(df, date, value)
            facts.append(report.as_facts(f"limitations:{name}", limits, (), digits))
    advice = business.prioritize(business.recommendations(df, numeric, categorical, dates))
    facts.append(report.as_facts("recommendations", advice, ["section", "rule"], digits))
    return report.report_table(facts)


def run_all(
    spark: SparkSession, path: str, output: str, key: Sequence[str], missing_threshold: float = 0.3
) -> dict[str, DataFrame]:
    """Load, clean, analyse and report; every result is written under ``output`` and returned as read back."""
    raw = read_table(spark, path)
    roles = schema.classify(raw)
    typed = schema.apply_roles(raw, roles)
    attributes = lambda names: [c for c in names if c not in key]
    cleaned = materialize(
        clean.clean(
            typed, attributes(roles.numeric), attributes(roles.categorical), attributes(roles.datetime), key, missing_threshold
        )
    )
    write_parquet(cleaned, f"{output}/cleaned")
    present = lambda names: tuple(c for c in names if c in cleaned.columns)
    kept = schema.RoleMap(
        present(roles.numeric), present(roles.categorical), present(roles.datetime), present(roles.other)
    )
    results = {
        "load": report.run_metadata(raw, path),
        "cleaning": clean.cleaning_summary(typed, cleaned, kept.categorical),
        "insights": describe.headline_insights(cleaned, kept.numeric, kept.categorical, kept.datetime),
        **analyze(cleaned, key, "auto", kept),
        "report": full_report(cleaned, path, key, kept),
    }
    for name, result in results.items():
        write_parquet(result, f"{output}/{name}")
    return {name: spark.read.parquet(f"{output}/{name}") for name in results}
