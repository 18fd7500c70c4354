"""Views over the test tables: the sales star, a soiled copy of the orders, daily and monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.timeseries import daily_series
from plumbline.session import apply_runtime_conf


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    apply_runtime_conf(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str, *needed: str) -> DataFrame:
    """Sales lines with the wanted attributes among market, product, channel, price and sale_date.

    Only the dimensions that supply a wanted attribute are joined.
    """
    lines = table(spark, folder, "lineitem")
    columns = []
    if "price" in needed:
        columns.append(F.col("l_extendedprice").alias("price"))
    if "product" in needed:
        parts = table(spark, folder, "part").select("p_partkey", "p_type")
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        columns.append(F.col("p_type").alias("product"))
    if {"market", "channel", "sale_date"} & set(needed):
        orders = table(spark, folder, "orders")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        columns += [F.col("o_orderpriority").alias("channel")] if "channel" in needed else []
        columns += [F.col("o_orderdate").alias("sale_date")] if "sale_date" in needed else []
    if "market" in needed:
        nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
        customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        homes = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        lines = lines.join(homes, F.col("o_custkey") == F.col("c_custkey"))
        columns.append(F.col("n_name").alias("market"))
    return lines.select(*columns)


SALES_SQL = """sales AS (
  SELECT n_name AS market, p_type AS product, o_orderpriority AS channel, l_extendedprice AS price,
         o_orderdate AS sale_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def soiled_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing prices, priorities, dates, a mostly empty column and repeated rows."""
    o = table(spark, folder, "orders")
    day, month = F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    soiled = o.select(
        "o_orderkey",
        F.when(~day.isin(13, 27), F.col("o_totalprice")).alias("price"),
        F.when(month != 2, F.col("o_orderpriority")).alias("priority"),
        F.when((F.col("o_orderstatus") != "P") | (month != 6), F.col("o_orderdate")).alias("ordered"),
        F.when(month == 1, F.col("o_orderstatus")).alias("sparse"),
        F.col("o_orderstatus").alias("status"),
        day.alias("_day"),
    )
    return soiled.drop("_day").unionAll(soiled.where("_day = 1").drop("_day"))


SOILED_SQL = """soiled_once AS (
  SELECT o_orderkey,
         CASE WHEN day(o_orderdate) NOT IN (13, 27) THEN o_totalprice END AS price,
         CASE WHEN month(o_orderdate) <> 2 THEN o_orderpriority END AS priority,
         CASE WHEN o_orderstatus <> 'P' OR month(o_orderdate) <> 6 THEN o_orderdate END AS ordered,
         CASE WHEN month(o_orderdate) = 1 THEN o_orderstatus END AS sparse,
         o_orderstatus AS status, day(o_orderdate) AS d
  FROM orders),
soiled AS (
  SELECT * EXCLUDE (d) FROM soiled_once UNION ALL SELECT * EXCLUDE (d) FROM soiled_once WHERE d = 1)"""


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sum of event values per event type: ``(event_type, ts, value)``."""
    return daily_series(table(spark, folder, "events"), "ts", "value", ["event_type"])


EVENT_DAYS_SQL = """event_days AS (
  SELECT event_type, CAST(ts AS DATE) AS ts, sum(value) AS value FROM events GROUP BY ALL)"""


def order_months(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly sum of order values: ``(ts, value)``."""
    return daily_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", grain="month")


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sum of order values: ``(ts, value)``."""
    return daily_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")


ORDER_DAYS_SQL = """order_days AS (
  SELECT CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"""


def text_features(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with simple numeric features of the whole text."""
    docs = table(spark, folder, "documents")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1
    digits = F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))
    features = docs.select(
        "doc_id",
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"),
        lines.cast("double").alias("n_lines"),
        digits.cast("double").alias("n_digits"),
    )
    return features.join(table(spark, folder, "labels"), "doc_id")


def embedding_columns(spark: SparkSession, folder: str, dims: int | None = None) -> DataFrame:
    """Embeddings with one column per dimension ``e0`` .. and the label."""
    e = table(spark, folder, "embeddings")
    width = dims or e.select(F.max(F.size("embedding"))).first()[0]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])
