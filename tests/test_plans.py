import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as driver
from plumbline.plans import analysis, catalog
from tools.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    rng = np.random.default_rng(23)
    n = 400
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "day": pd.date_range("2020-01-01", periods=n, freq="3D").strftime("%Y-%m-%d"),
            "size": rng.integers(1, 9, n),
            "weight": rng.normal(5, 1, n).round(2),
            "kind": rng.choice(["a", "b", "c"], n),
        }
    )
    pdf["price"] = (3 * pdf["size"] + pdf["weight"] + rng.normal(size=n)).round(2)
    pdf.loc[::9, "weight"] = np.nan
    path = tmp_path_factory.mktemp("shop") / "shop.csv"
    pd.concat([pdf, pdf.head(7)]).to_csv(path, index=False)
    return str(path)


def test_run_all(spark, shop, tmp_path):
    results = analysis.run_all(spark, shop, str(tmp_path / "out"), ["id"])
    assert results["load"].first()["rows"] == 407
    facts = {r["step"]: r["value"] for r in results["cleaning"].collect()}
    assert facts["duplicates_removed"] == 7 and facts["missing_after"] == 0
    assert results["best_model"].count() == 1
    sections = {r["section"] for r in results["report"].select("section").distinct().collect()}
    assert {"metadata", "quality", "statistics", "coverage:day", "recommendations", "changes:day:price"} <= sections
    cleaned = spark.read.parquet(str(tmp_path / "out" / "cleaned"))
    assert cleaned.count() == 400 and "kind_encoded" in cleaned.columns


def test_modes_nest(spark, shop):
    from plumbline.sources.readers import read_table

    df = read_table(spark, shop)
    minimal = analysis.analyze(df, ["id"], "minimal")
    assert set(minimal) == {"dtypes", "missing", "numeric"}
    with pytest.raises(ValueError):
        analysis.analyze(df, ["id"], "everything")


def test_registry_is_consistent():
    queries, oracles = driver.queries(), driver.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 90
    assert not [n for n in catalog.QUERIES if re.match(r"op\d|.*pipeline", n)]
    assert set(catalog.QUERIES) <= set(queries)


@pytest.fixture(scope="module")
def reference():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize(
    "name",
    [
        "market_share", "quality_issues", "impute_dates", "numeric_describe_extended", "spearman_correlation",
        "moving_averages", "decomposition", "change_metrics", "roc_curve", "k_by_ratio", "workbook_scan", "folder_watch",
    ],
)
def test_query_equals_sql(spark, reference, name):
    df = driver.queries()[name](spark, FOLDER)
    cursor = reference.execute(driver.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
