"""Sales breakdowns and rule-based recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.statistics import safe_divide
from plumbline.operators.quality import missing_totals
from plumbline.operators.schema import one_row_to_long


def group_share(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """``(value, n, share_pct)``: rows per value and their share of all rows of the table.

    The total is the sum of the same counts, NULL group included, so the input is read once: the
    exchange of the counts is reused. The filter stays on an aggregate for that reason.
    """
    counted = df.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col(column).isNotNull()).alias("_known")
    )
    total = counted.agg(F.sum("n")).scalar()
    return counted.where("_known").select(
        "value", "n", F.round(safe_divide(F.col("n") * 100, total), digits).alias("share_pct")
    )


def share_within_market(df: DataFrame, market: str, product: str, digits: int = 4) -> DataFrame:
    """``(market, product, n, share_pct)``: product mix of every market."""
    cells = (
        df.where(F.col(market).isNotNull() & F.col(product).isNotNull())
        .groupBy(F.col(market).alias("market"), F.col(product).alias("product"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = cells.groupBy("market").agg(F.sum("n").alias("_total"))
    return cells.join(totals, "market").select(
        "market", "product", "n", F.round(F.col("n") * 100 / F.col("_total"), digits).alias("share_pct")
    )


def frequent_prices(df: DataFrame, price: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent price points."""
    counted = df.where(F.col(price).isNotNull()).groupBy(F.col(price).alias("price"))
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "price").limit(k)


def product_demand(df: DataFrame, product: str, days: int = 30, growth_pct: int = 10) -> DataFrame:
    """Demand per product, per day, and projected with a growth rate (whole units, rounded down)."""
    counted = df.where(F.col(product).isNotNull()).groupBy(F.col(product).alias("product"))
    return counted.agg(F.count(F.lit(1)).alias("demand")).select(
        "product",
        "demand",
        F.round(F.col("demand") / days, 4).alias("daily_demand"),
        F.floor(F.col("demand") * (100 + growth_pct) / 100).cast("long").alias("projected_demand"),
    )


def below_average_groups(df: DataFrame, column: str, action: str | None = None) -> DataFrame:
    """``(value, n, gap)``: groups with fewer rows than the mean group, and the shortfall."""
    counted = (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    mean = counted.agg(F.avg("n")).scalar()
    result = counted.where(F.col("n") < mean).withColumn("gap", F.round(mean - F.col("n"), 0))
    return result if action is None else result.withColumn("action", F.lit(action))


def top_products(df: DataFrame, product: str, k: int = 3, increase_pct: int = 20) -> DataFrame:
    """The ``k`` best-selling products with the proposed capacity increase."""
    counted = df.where(F.col(product).isNotNull()).groupBy(F.col(product).alias("product"))
    ranked = counted.agg(F.count(F.lit(1)).alias("demand")).orderBy(F.desc("demand"), "product").limit(k)
    return ranked.withColumn("capacity_increase_pct", F.lit(increase_pct))


# Advice texts by topic.
ADVICE = {
    "missing": "Address missing values ({}% of data is missing)",
    "more_rows": "Collect more data to improve analysis reliability",
    "normalize": "Consider normalizing numeric features for more reliable comparisons",
    "encode": "Encode categorical variables for advanced machine learning techniques",
    "temporal": "Extract more temporal features (month, day of week, etc.) for enhanced time analysis",
    "scatter": "Create scatter plots to visualize relationships between numeric variables",
    "box": "Use box plots to compare numeric distributions across categories",
    "lines": "Generate time series plots to visualize temporal patterns",
    "regression": "Apply regression models to predict numeric outcomes",
    "classification": "Use classification algorithms to categorize and predict classes",
    "clustering": "Implement clustering to discover natural groupings in the data",
}


def recommendations(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], datetime: Sequence[str]
) -> DataFrame:
    """``(section, rule, recommendation)`` for every rule that the profile of the table meets."""
    num, cat, day = len(numeric), len(categorical), len(datetime)
    holds = {
        ("general", "missing"): F.col("missing_pct") > 5,
        ("general", "more_rows"): F.col("rows") < 100,
        ("general", "normalize"): F.lit(num > 0),
        ("general", "encode"): F.lit(cat > 0),
        ("general", "temporal"): F.lit(day > 0),
        ("visualization", "scatter"): F.lit(num >= 2),
        ("visualization", "box"): F.lit(cat >= 1 and num >= 1),
        ("visualization", "lines"): F.lit(day >= 1 and num >= 1),
        ("machine_learning", "regression"): F.lit(num >= 2),
        ("machine_learning", "classification"): F.lit(cat >= 1),
        ("machine_learning", "clustering"): F.col("rows") >= 100,
    }
    rules = []
    for (section, rule), condition in holds.items():
        before, gap, after = ADVICE[rule].partition("{}")
        text = F.concat(F.lit(before), F.format_string("%.2f", "missing_pct"), F.lit(after)) if gap else F.lit(before)
        rules.append(
            F.struct(
                F.lit(section).alias("section"),
                F.lit(rule).alias("rule"),
                text.alias("recommendation"),
                condition.alias("holds"),
            )
        )
    return one_row_to_long(missing_totals(df), rules).where("holds").drop("holds")


# Priority score by impact and effort.
PRIORITY_SCORES = [
    ("High", "Low", 9),
    ("High", "Medium", 8),
    ("Medium", "Low", 7),
    ("High", "High", 6),
    ("Medium", "Medium", 5),
    ("Low", "Low", 4),
    ("Medium", "High", 3),
    ("Low", "Medium", 2),
    ("Low", "High", 1),
]


def prioritize(advice: DataFrame, text: str = "recommendation") -> DataFrame:
    """Add impact, effort and priority score to advice texts, highest priority first."""
    lowered = F.lower(F.col(text))
    mentions = lambda *words: F.coalesce(*[F.nullif(lowered.contains(w), F.lit(False)) for w in words], F.lit(False))
    urgent = mentions("missing values", "collect more data")
    feature = mentions("feature", "variables")
    scaling = mentions("normaliz")
    graded = advice.withColumns(
        {
            "impact": F.when(urgent, "High").otherwise("Medium"),
            "effort": F.when(urgent | feature, "Medium").when(scaling, "Low").otherwise("Medium"),
        }
    )
    scores = advice.sparkSession.createDataFrame(PRIORITY_SCORES, "impact string, effort string, priority_score int")
    return graded.join(F.broadcast(scores), ["impact", "effort"]).orderBy(F.desc("priority_score"), text)
