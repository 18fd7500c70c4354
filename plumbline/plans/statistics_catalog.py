"""Queries on distributions, association and sales breakdowns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import associate, business, describe, quality, report, schema
from plumbline.plans.analysis import full_report
from plumbline.plans.registry import query, rounded, union_all
from plumbline.plans.views import SALES_SQL, SOILED_SQL, sales, soiled_orders, table

_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TEXTS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


def _describe_sql(source: str, column: str, label: str | None = None, extended: bool = False) -> str:
    more = f", round(skewness({column}), 4) AS skewness, round(kurtosis({column}), 4) AS kurtosis" if extended else ""
    return (
        f"SELECT '{label or column}' AS \"column\", count({column}) AS n, round(avg({column}), 4) AS mean, "
        f"round(stddev_samp({column}), 4) AS std, round(min({column}), 4) AS \"min\", "
        f"round(quantile_cont({column}, 0.25), 4) AS q1, round(quantile_cont({column}, 0.5), 4) AS median, "
        f"round(quantile_cont({column}, 0.75), 4) AS q3, round(max({column}), 4) AS \"max\"{more} FROM {source}"
    )


@query(union_all([_describe_sql("lineitem", c) for c in _LINE_NUMBERS]))
def numeric_describe(spark, d):
    result = describe.numeric_describe(table(spark, d, "lineitem"), _LINE_NUMBERS)
    return rounded(result.withColumnRenamed("count", "n"))


@query(
    union_all([_describe_sql("lineitem", c, extended=True) for c in _LINE_NUMBERS])
    + "\nUNION ALL\n"
    + _describe_sql("events", "value", extended=True)
)
def numeric_describe_extended(spark, d):
    lines = describe.numeric_describe(table(spark, d, "lineitem"), _LINE_NUMBERS, extended=True)
    events = describe.numeric_describe(table(spark, d, "events"), ["value"], extended=True)
    return rounded(lines.unionByName(events).withColumnRenamed("count", "n"))


@query(
    union_all(
        [
            f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM orders) AS unique_values, v AS most_common, n AS most_common_count, "
            f"round(n * 100.0 / (SELECT count(*) FROM orders), 2) AS most_common_pct FROM "
            f"(SELECT {c}::VARCHAR AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
            for c in _TEXTS
        ]
    )
)
def categorical_summary(spark, d):
    return describe.categorical_summary(table(spark, d, "orders"), _TEXTS)


@query(
    "WITH c AS ("
    + union_all([f"SELECT '{c}' AS c, {c}::VARCHAR AS v, count(*) AS n FROM orders GROUP BY ALL" for c in _TEXTS])
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r FROM c)
    SELECT c AS "column", v AS value, n, r AS rank, round(n * 100.0 / (SELECT count(*) FROM orders), 2) AS pct FROM r WHERE r <= 5"""
)
def top_categories(spark, d):
    return rounded(describe.top_categories(table(spark, d, "orders"), _TEXTS))


@query(f"WITH {SOILED_SQL} SELECT priority AS value, count(*) AS n FROM soiled WHERE priority IS NOT NULL GROUP BY 1")
def frequency_table(spark, d):
    return describe.frequency_table(soiled_orders(spark, d), "priority")


@query(
    f"""WITH {SOILED_SQL} SELECT priority AS value, count(*) AS n,
    round(count(*) * 100.0 / (SELECT count(priority) FROM soiled), 6) AS pct FROM soiled WHERE priority IS NOT NULL GROUP BY 1"""
)
def share_table(spark, d):
    return describe.share_table(soiled_orders(spark, d), "priority")


@query(
    union_all(
        [
            f"SELECT '{c}' AS \"column\", strftime(min({c}), '%Y-%m-%d') AS first, strftime(max({c}), '%Y-%m-%d') AS last, "
            f"(epoch_us(max({c})) - epoch_us(min({c}))) // 86400000000 AS range_days, count(DISTINCT {c}::DATE) AS unique_dates FROM {t}"
            for c, t in [("ts", "events"), ("o_orderdate", "orders"), ("l_shipdate", "lineitem")]
        ]
    )
)
def datetime_summary(spark, d):
    parts = [("ts", "events"), ("o_orderdate", "orders"), ("l_shipdate", "lineitem")]
    results = [describe.datetime_summary(table(spark, d, t), [c]) for c, t in parts]
    return results[0].unionByName(results[1]).unionByName(results[2])


_HISTOGRAM = """s AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM x),
b AS (SELECT lo, hi, n, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0/3)))::BIGINT AS bins FROM s),
h AS (SELECT least(floor((x - lo) / ((hi - lo) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n FROM x, b GROUP BY 1)"""


@query(
    f"""WITH x AS (SELECT o_totalprice AS x FROM orders), {_HISTOGRAM}
    SELECT i AS bin, round(lo + i * (hi - lo) / bins, 4) AS lower, round(lo + (i + 1) * (hi - lo) / bins, 4) AS upper, coalesce(h.n, 0) AS n
    FROM (SELECT *, unnest(range(bins)) AS i FROM b) LEFT JOIN h ON i = bin"""
)
def histogram_bins(spark, d):
    return rounded(describe.histogram(table(spark, d, "orders"), "o_totalprice"))


@query(
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS bw FROM events),
    h AS (SELECT floor((value - lo) / (bw / 8)) AS b, count(*) AS n, avg(value) AS c FROM events, s GROUP BY 1),
    g AS (SELECT unnest(range(200)) AS grid)
    SELECT grid, round(any_value(lo + (hi - lo) * grid / 199), 4) AS x,
      round(sum(h.n * exp(-pow((lo + (hi - lo) * grid / 199 - c) / bw, 2) / 2)) / any_value(s.n * bw * sqrt(2 * pi())), 7) AS density
    FROM g, h, s GROUP BY grid"""
)
def density_curve(spark, d):
    return rounded(describe.density_curve(table(spark, d, "events"), "value"), 4, density=7)


@query(
    """WITH s AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS bw, min(value) AS lo, max(value) AS hi FROM events),
    v AS (SELECT value, count(*) AS m FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT grid, round(sum(m * exp(-pow((lo + (hi - lo) * grid / 9 - value) / bw, 2) / 2)) / any_value(n * bw * sqrt(2 * pi())) / 0.05 * any_value(hi - lo), 0) AS twentieths
    FROM v, s, (SELECT unnest(range(10)) AS grid) GROUP BY grid"""
)
def density_over_all_rows(spark, d):
    """Ten places of the default curve, as twentieths of an even density: what a sum over all rows gives, without cells."""
    curve = describe.density_curve(table(spark, d, "events"), "value", points=10)
    width = table(spark, d, "events").agg(F.max("value") - F.min("value")).scalar()
    return rounded(curve.select("grid", (F.col("density") / 0.05 * width).alias("twentieths")), 0)


def _quartile_sql(body: str, table_name: str, columns: list[str]) -> str:
    return union_all(
        [
            f"SELECT '{c}' AS \"column\", {body.format(c=c)} FROM {table_name}, (SELECT quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {table_name})"
            for c in columns
        ]
    )


@query(
    _quartile_sql(
        "round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3, "
        "round(min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low, "
        "round(max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high, "
        "count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers",
        "events",
        ["value", "user_id"],
    )
)
def box_plot(spark, d):
    return rounded(describe.box_plot(table(spark, d, "events"), ["value", "user_id"]))


@query(
    _quartile_sql(
        "round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper_bound, "
        "count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, "
        "round(count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) * 100.0 / count({c}), 4) AS outlier_pct",
        "events",
        ["value", "user_id"],
    )
)
def iqr_outliers(spark, d):
    return rounded(describe.iqr_outliers(table(spark, d, "events"), ["value", "user_id"]))


@query(
    """SELECT event_id, value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS is_outlier
    FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"""
)
def iqr_outlier_rows(spark, d):
    return describe.flag_iqr_outliers(table(spark, d, "events").select("event_id", "value"), "value").drop("value")


@query(
    union_all(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER (abs(({c} - m) / s) > 3) AS outliers, "
            f"round(count(*) FILTER (abs(({c} - m) / s) > 3) * 100.0 / count({c}), 4) AS outlier_pct "
            f"FROM {t}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {t})"
            for c, t in [("value", "events"), ("user_id", "events")]
        ]
    )
)
def z_outliers(spark, d):
    return rounded(describe.z_outliers(table(spark, d, "events"), ["value", "user_id"]))


def _corr_sql(a: str, b: str, source: str, digits: int) -> str:
    return f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), {digits}) + 0.0 AS correlation FROM {source}"


@query(
    union_all(
        [_corr_sql(a, b, "lineitem", 3) for a in _LINE_NUMBERS for b in _LINE_NUMBERS if a != b]
        + [f"SELECT '{a}', '{a}', 1.0::DOUBLE FROM (SELECT 1 FROM lineitem LIMIT 1)" for a in _LINE_NUMBERS]
    )
)
def correlation_matrix(spark, d):
    return rounded(associate.correlation_matrix(table(spark, d, "lineitem"), _LINE_NUMBERS))


_DERIVED = ["l_quantity", "l_extendedprice", "net", "charge", "rebate"]
_DERIVED_SQL = """x AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_extendedprice * l_discount AS rebate FROM lineitem)"""


def _derived(spark, d):
    price, keep = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return table(spark, d, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        (price * keep).alias("net"),
        (price * keep * (1 + F.col("l_tax"))).alias("charge"),
        (-price * F.col("l_discount")).alias("rebate"),
    )


@query(
    f"WITH {_DERIVED_SQL}, c AS ("
    + union_all([_corr_sql(a, b, "x", 4) for a, b in combinations(_DERIVED, 2)])
    + """) SELECT *, CASE WHEN abs(correlation) > 0.7 THEN 'Strong' ELSE 'Moderate' END AS strength,
    CASE WHEN correlation > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM c WHERE abs(correlation) > 0.5"""
)
def significant_pairs(spark, d):
    return rounded(associate.significant_pairs(_derived(spark, d), _DERIVED))


@query(
    f"WITH {_DERIVED_SQL}, c AS ("
    + union_all([_corr_sql(a, b, "x", 3) for a in _DERIVED for b in _DERIVED if a != b])
    + ") SELECT feature1 || '_vs_' || feature2 AS pair, correlation FROM c WHERE abs(correlation) > 0.5"
)
def significant_pair_map(spark, d):
    return rounded(associate.significant_pair_map(_derived(spark, d), _DERIVED))


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
      rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT 'l_quantity' AS feature1, 'l_extendedprice' AS feature2, round(corr(a, b), 4) + 0.0 AS spearman, count(*) AS n FROM r"""
)
def spearman_correlation(spark, d):
    return rounded(associate.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


def _jb_sql(c: str, source: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", 'Jarque-Bera' AS test, n, round(jb, 4) AS statistic, round(exp(-jb / 2), 6) AS p_value, "
        f"round(sk, 4) AS skewness, round(ku, 4) AS kurtosis, exp(-jb / 2) > 0.05 AS is_normal FROM ("
        f"SELECT any_value(n) AS n, any_value(sk) AS sk, any_value(ku) AS ku, "
        f"any_value(n) / 6.0 * (pow(avg(pow(({c} - m) / s, 3)), 2) + pow(avg(pow(({c} - m) / s, 4)) - 3, 2) / 4) AS jb FROM {source}, "
        f"(SELECT count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS s, skewness({c}) AS sk, kurtosis({c}) AS ku FROM {source}))"
    )


@query(union_all([_jb_sql("value", "events"), _jb_sql("user_id", "events")]))
def normality_by_moments(spark, d):
    return rounded(associate.jarque_bera(table(spark, d, "events"), ["value", "user_id"]), 4, p_value=6)


@query()
def normality_by_order(spark, d):
    return rounded(associate.shapiro_wilk(table(spark, d, "orders"), "o_totalprice"), 6)


_MI_FEATURES = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
_FENCES = ", ".join(f"quantile_cont({{c}}, {i / 10})" for i in range(1, 10))


def _bins_above(c: str) -> str:
    return "(" + " + ".join(f"(f_{c}[{i}] < {c})::INT" for i in range(1, 10)) + ")"


@query(
    "WITH f AS (SELECT "
    + ", ".join(f"[{_FENCES.format(c=c)}] AS f_{c}" for c in ("l_quantity", "l_discount", "l_extendedprice"))
    + f""" FROM lineitem), b AS (SELECT {_bins_above("l_extendedprice")} AS t, {_bins_above("l_quantity")}::VARCHAR AS l_quantity,
      {_bins_above("l_discount")}::VARCHAR AS l_discount, l_returnflag, l_linestatus FROM lineitem, f),
    u AS (UNPIVOT b ON l_quantity, l_discount, l_returnflag, l_linestatus INTO NAME feature VALUE v),
    c AS (SELECT feature, v, t, count(*) AS n FROM u GROUP BY ALL),
    m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, v) AS nf,
      sum(n) OVER (PARTITION BY feature, t) AS nt FROM c)
    SELECT feature, round(sum(n / a * ln(n * a / (nf * nt))), 6) AS mutual_info, sum(n)::BIGINT AS n FROM m GROUP BY feature"""
)
def mutual_information(spark, d):
    return rounded(associate.mutual_information(table(spark, d, "lineitem"), _MI_FEATURES, "l_extendedprice"), 6)


@query(
    """WITH s AS (SELECT p_brand AS row_value, p_type AS col_value, count(*) AS n FROM part GROUP BY ALL)
    SELECT r.row_value, c.col_value, coalesce(n, 0) AS n FROM (SELECT DISTINCT row_value FROM s) r
    CROSS JOIN (SELECT DISTINCT col_value FROM s) c LEFT JOIN s USING (row_value, col_value)"""
)
def contingency_dense(spark, d):
    return associate.contingency(table(spark, d, "part"), "p_brand", "p_type", dense=True)


@query(
    """SELECT row_value, col_value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY row_value), 4) AS share FROM (
      SELECT o_orderpriority AS row_value, o_orderstatus AS col_value, count(*) AS n FROM orders GROUP BY ALL)"""
)
def contingency_row_shares(spark, d):
    return associate.row_shares(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


_PAIRED = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    union_all(
        [
            f"SELECT '{a}' AS column1, {a}::VARCHAR AS value1, '{b}' AS column2, {b}::VARCHAR AS value2, count(*) AS n FROM lineitem GROUP BY ALL"
            for a, b in combinations(_PAIRED, 2)
        ]
    )
)
def contingency_all_pairs(spark, d):
    return associate.pairwise_contingency(table(spark, d, "lineitem"), _PAIRED)


@query(
    """SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, count(*) AS n,
    grouping_id(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS margin_level FROM lineitem
    GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)"""
)
def joint_frequency(spark, d):
    return associate.joint_frequency(table(spark, d, "lineitem"), _PAIRED, margins=True)


def _leading_sql(c: str) -> str:
    return (
        f"SELECT 'most_common' AS insight, '{c}' AS subject, v || ' (' || printf('%.2f', n * 100.0 / (SELECT count({c}) FROM orders)) || '%)' AS value "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
    )


@query(
    union_all(
        [
            "SELECT 'records' AS insight, NULL AS subject, count(*)::VARCHAR AS value FROM orders",
            "SELECT 'variables', NULL, '6' FROM (SELECT 1 FROM orders LIMIT 1)",
            "SELECT 'average', 'o_totalprice', printf('%.2f', avg(o_totalprice)) FROM orders",
            "SELECT 'span_days', 'o_orderdate', date_diff('day', min(o_orderdate), max(o_orderdate))::VARCHAR FROM orders",
            "SELECT 'first_date', 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d') FROM orders",
            "SELECT 'last_date', 'o_orderdate', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders",
            _leading_sql("o_orderstatus"),
            _leading_sql("o_orderpriority"),
        ]
    )
)
def headline_insights(spark, d):
    o = table(spark, d, "orders")
    return describe.headline_insights(o, ["o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"])


@query(
    union_all(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) BETWEEN 2 AND 10 AS is_target FROM part"
            for c in ("p_type", "p_brand", "p_name")
        ]
    )
)
def categorical_targets(spark, d):
    return describe.categorical_targets(table(spark, d, "part"), ["p_type", "p_brand", "p_name"])


@query(
    """SELECT count(*) AS n, true AS regression, count(DISTINCT p_type) BETWEEN 2 AND 10 OR count(DISTINCT p_brand) BETWEEN 2 AND 10
    OR count(DISTINCT p_name) BETWEEN 2 AND 10 AS classification, count(*) >= 10 AS clustering FROM part"""
)
def data_suitability(spark, d):
    p = table(spark, d, "part")
    roles = schema.classify(p)
    return describe.suitability(p, roles.numeric, roles.categorical).withColumnRenamed("rows", "n")


# ---------------------------------------------------------------- sales breakdowns


def _share_sql(column: str) -> str:
    return (
        f"WITH {SALES_SQL} SELECT {column} AS value, count(*) AS n, "
        f"round(count(*) * 100.0 / (SELECT count(*) FROM sales), 6) AS share_pct FROM sales GROUP BY 1"
    )


@query(_share_sql("market"))
def market_share(spark, d):
    return business.group_share(sales(spark, d, "market"), "market")


@query(_share_sql("product"))
def product_share(spark, d):
    return business.group_share(sales(spark, d, "product"), "product")


@query(_share_sql("channel"))
def channel_share(spark, d):
    return business.group_share(sales(spark, d, "channel"), "channel")


@query(
    f"""WITH {SALES_SQL} SELECT market, product, n, round(n * 100.0 / sum(n) OVER (PARTITION BY market), 4) AS share_pct
    FROM (SELECT market, product, count(*) AS n FROM sales GROUP BY ALL)"""
)
def product_share_by_market(spark, d):
    return business.share_within_market(sales(spark, d, "market", "product"), "market", "product")


@query("SELECT l_extendedprice AS price, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, price LIMIT 10")
def frequent_prices(spark, d):
    return business.frequent_prices(sales(spark, d, "price"), "price")


@query(
    f"""WITH {SALES_SQL} SELECT product, count(*) AS demand, round(count(*) / 30.0, 4) AS daily_demand,
    count(*) * 110 // 100 AS projected_demand FROM sales GROUP BY 1"""
)
def product_demand(spark, d):
    return business.product_demand(sales(spark, d, "product"), "product")


@query(
    f"""WITH {SALES_SQL}, g AS (SELECT market AS value, count(*) AS n FROM sales GROUP BY 1)
    SELECT value, n, round((SELECT avg(n) FROM g) - n, 0) + 0.0 AS gap FROM g WHERE n < (SELECT avg(n) FROM g)"""
)
def weak_markets(spark, d):
    return rounded(business.below_average_groups(sales(spark, d, "market"), "market"))


@query(
    f"""WITH {SALES_SQL} SELECT product, count(*) AS demand, 20::BIGINT AS capacity_increase_pct FROM sales
    GROUP BY 1 ORDER BY demand DESC, product LIMIT 3"""
)
def products_to_expand(spark, d):
    return rounded(business.top_products(sales(spark, d, "product"), "product"))


@query(
    f"""WITH {SALES_SQL}, g AS (SELECT channel AS value, count(*) AS n FROM sales GROUP BY 1)
    SELECT value, n, round((SELECT avg(n) FROM g) - n, 0) + 0.0 AS gap, 'Implement promotional campaign to boost sales' AS action
    FROM g WHERE n < (SELECT avg(n) FROM g)"""
)
def weak_channels(spark, d):
    action = "Implement promotional campaign to boost sales"
    return rounded(business.below_average_groups(sales(spark, d, "channel"), "channel", action))


_SOILED_COLUMNS = ["o_orderkey", "price", "priority", "ordered", "sparse", "status"]
_MISSING_PCT = (
    "round((" + " + ".join(f"(count(*) - count({c}))" for c in _SOILED_COLUMNS) + ") * 100.0 / (count(*) * 6), 2)"
)


def _rules_sql() -> str:
    always = ["normalize", "encode", "temporal", "scatter", "box", "lines", "regression", "classification"]
    sections = dict.fromkeys(["normalize", "encode", "temporal"], "general")
    sections |= dict.fromkeys(["scatter", "box", "lines"], "visualization")
    sections |= dict.fromkeys(["regression", "classification"], "machine_learning")
    parts = [
        f"SELECT 'general' AS section, 'missing' AS rule, 'Address missing values (' || printf('%.2f', pct) || '% of data is missing)' AS recommendation, pct > 5 AS holds FROM p",
        f"SELECT 'general', 'more_rows', '{business.ADVICE['more_rows']}', n < 100 FROM p",
        f"SELECT 'machine_learning', 'clustering', '{business.ADVICE['clustering']}', n >= 100 FROM p",
    ]
    parts += [f"SELECT '{sections[r]}', '{r}', '{business.ADVICE[r]}', true FROM p" for r in always]
    return f"WITH {SOILED_SQL}, p AS (SELECT count(*) AS n, {_MISSING_PCT} AS pct FROM soiled), r AS ({union_all(parts)})"


def _advice(spark, d):
    return business.recommendations(
        soiled_orders(spark, d), ["o_orderkey", "price"], ["priority", "sparse", "status"], ["ordered"]
    )


@query(_rules_sql() + " SELECT section, rule, recommendation FROM r WHERE holds")
def recommendations(spark, d):
    return _advice(spark, d)


@query(
    _rules_sql()
    + """, g AS (SELECT section, rule, recommendation,
      CASE WHEN recommendation ILIKE '%missing values%' OR recommendation ILIKE '%collect more data%' THEN 'High' ELSE 'Medium' END AS impact,
      CASE WHEN recommendation ILIKE '%missing values%' OR recommendation ILIKE '%collect more data%'
        OR recommendation ILIKE '%feature%' OR recommendation ILIKE '%variables%' THEN 'Medium'
        WHEN recommendation ILIKE '%normaliz%' THEN 'Low' ELSE 'Medium' END AS effort FROM r WHERE holds)
    SELECT *, CASE WHEN impact = 'High' THEN 8 WHEN effort = 'Low' THEN 7 ELSE 5 END::BIGINT AS priority_score FROM g"""
)
def prioritized_recommendations(spark, d):
    return rounded(business.prioritize(_advice(spark, d)))


# ---------------------------------------------------------------- report table


@query(
    f"""WITH {SOILED_SQL}, q AS (SELECT count(*) AS n, 100 - ({_MISSING_PCT.replace(', 2)', ', 10)')}) AS c,
      100 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM soiled))) * 100.0 / count(*) AS u FROM soiled),
    s AS (SELECT count(price) AS n, avg(price) AS mean, stddev_samp(price) AS std, min(price) AS lo, quantile_cont(price, 0.25) AS q1,
      quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3, max(price) AS hi FROM soiled)
    SELECT section, subject, metric, round(v, 3) AS value_num, t AS value_str FROM (
      SELECT 'metadata' AS section, 'orders' AS subject, unnest(['rows', 'columns']) AS metric, unnest([n, 6.0]) AS v, NULL::VARCHAR AS t FROM q
      UNION ALL SELECT 'quality', 'table', unnest(['rows', 'columns', 'completeness_score', 'uniqueness_score', 'quality_score']),
        unnest([n, 6.0, c, u, (c + u) / 2]), NULL FROM q
      UNION ALL SELECT 'statistics', 'price', unnest(['count', 'mean', 'std', 'min', 'q1', 'median', 'q3', 'max']),
        unnest([n, mean, std, lo, q1, q2, q3, hi]), NULL FROM s
      UNION ALL SELECT 'categories', 'status', 'n', NULL, n::VARCHAR FROM (SELECT count(DISTINCT status) AS n FROM soiled))"""
)
def report_facts(spark, d):
    df = soiled_orders(spark, d)
    kinds = schema.distinct_counts(df, ["status"]).select("column", F.col("distinct_values").cast("string").alias("n"))
    return report.report_table(
        [
            report.as_facts("metadata", report.run_metadata(df, "orders", with_time=False), ["source"], 3),
            report.as_facts("quality", quality.quality_score(df), (), 3),
            report.as_facts("statistics", describe.numeric_describe(df, ["price"]), ["column"], 3),
            report.as_facts("categories", kinds, ["column"], 3),
        ]
    )


@query()
def full_report_table(spark, d):
    """Every section of the report for the soiled orders."""
    return full_report(soiled_orders(spark, d), "orders", ["o_orderkey"], digits=4)
