"""Queries on time series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.ordered import over_neighbours, with_position
from plumbline.operators import changepoints, forecast, timeseries as ts
from plumbline.plans.registry import query, rounded, union_all
from plumbline.plans.views import (
    EVENT_DAYS_SQL,
    ORDER_DAYS_SQL,
    event_days,
    order_days,
    order_months,
    table,
)


def _iso(df, *columns):
    """Dates as text, which every engine prints alike."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(spark, d):
    return _iso(ts.daily_counts(table(spark, d, "events"), "ts"), "day")


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL")
def monthly_counts(spark, d):
    return rounded(ts.monthly_counts(table(spark, d, "orders"), "o_orderdate"))


@query(
    """SELECT strftime(min(ts), '%Y-%m-%d') AS start, strftime(max(ts), '%Y-%m-%d') AS "end",
    (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS span_days FROM events"""
)
def date_range(spark, d):
    return ts.date_range(table(spark, d, "events"), "ts")


@query(
    "SELECT dayname(l_shipdate) AS day, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 4) AS pct FROM lineitem GROUP BY 1"
)
def weekday_distribution(spark, d):
    return ts.weekday_distribution(table(spark, d, "lineitem"), "l_shipdate")


def _grid_sql(extra: str = "") -> str:
    days = ", ".join(f"count(*) FILTER (isodow(o_orderdate) = {i + 1}) AS d{i}" for i in range(7))
    return f"SELECT {extra}week(o_orderdate) AS week, {days} FROM orders GROUP BY ALL"


@query(_grid_sql())
def calendar_grid(spark, d):
    return ts.calendar_grid(table(spark, d, "orders"), "o_orderdate")


@query(_grid_sql("isoyear(o_orderdate) AS iso_year, "))
def calendar_grid_by_year(spark, d):
    return ts.calendar_grid(table(spark, d, "orders"), "o_orderdate", split_years=True)


@query(
    """WITH m AS (SELECT date_trunc('month', l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY 1),
    g AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM m)
    SELECT strftime(g.m, '%Y-%m-%d') AS month, coalesce(n, 0) AS total FROM g LEFT JOIN m USING (m)"""
)
def monthly_totals(spark, d):
    return _iso(ts.monthly_totals(table(spark, d, "lineitem"), "l_shipdate"), "month")


@query(
    """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, o_orderpriority AS category, count(*) AS n
    FROM orders GROUP BY ALL"""
)
def period_by_category(spark, d):
    counts = ts.period_category_counts(table(spark, d, "orders"), "o_orderdate", "o_orderpriority")
    return _iso(counts, "period")


@query(
    union_all(
        [
            f"SELECT '{g}' AS grain, strftime(date_trunc('{g}', o_orderdate), '%Y-%m-%d') AS period, o_orderpriority AS category, count(*) AS n FROM orders "
            f"WHERE date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) < {days} GROUP BY ALL"
            for g, days in (("day", 20), ("month", 200))
        ]
    )
)
def period_by_category_short(spark, d):
    """The grain that follows the span of the dates: days up to a month of them, months up to a year."""
    orders, parts = table(spark, d, "orders"), []
    first = orders.agg(F.min("o_orderdate")).scalar()
    for grain, days in (("day", 20), ("month", 200)):
        span = orders.where(F.date_diff("o_orderdate", first) < days)
        counts = ts.period_category_counts(span, "o_orderdate", "o_orderpriority")
        parts.append(_iso(counts, "period").select(F.lit(grain).alias("grain"), "period", "category", "n"))
    return parts[0].unionByName(parts[1])


_CODE_SQL = """CASE WHEN g IS NULL THEN NULL WHEN g < 86400e6 THEN CASE WHEN g <= 3600e6 THEN 'H' WHEN g <= 6 * 3600e6 THEN '6H' ELSE 'D' END
  WHEN g < 2 * 86400e6 THEN 'D' WHEN g < 8 * 86400e6 THEN 'W' WHEN g < 16 * 86400e6 THEN '2W' WHEN g < 35 * 86400e6 THEN 'M'
  WHEN g < 100 * 86400e6 THEN 'Q' ELSE 'A' END AS frequency"""


def _gap_code_sql(source: str, date: str, key: str | None) -> str:
    part = f"PARTITION BY {key} " if key else ""
    k = f"{key}, " if key else ""
    group = f" GROUP BY {key}" if key else ""
    return f"""SELECT {k}{_CODE_SQL} FROM (SELECT {k}quantile_cont(g, 0.5) AS g FROM (SELECT {k}epoch_us({date}) -
      lag(epoch_us({date})) OVER ({part}ORDER BY {date}) AS g FROM (SELECT DISTINCT {k}{date} FROM {source})){group})"""


@query(_gap_code_sql("events", "ts", None))
def frequency_code(spark, d):
    return ts.frequency_code(table(spark, d, "events"), "ts")


@query(_gap_code_sql("orders", "o_orderdate", "o_custkey"))
def frequency_code_by_customer(spark, d):
    return ts.frequency_code(table(spark, d, "orders"), "o_orderdate", ["o_custkey"])


_LABEL_SQL = """CASE WHEN g IS NULL THEN 'Insufficient data points' WHEN g <= 1 THEN 'Daily' WHEN g BETWEEN 6 AND 8 THEN 'Weekly'
  WHEN g BETWEEN 28 AND 31 THEN 'Monthly' WHEN g BETWEEN 90 AND 92 THEN 'Quarterly' WHEN g BETWEEN 365 AND 366 THEN 'Yearly'
  ELSE 'Approximately every ' || floor(g)::INT || ' days' END AS frequency"""


@query(
    f"""SELECT {_LABEL_SQL} FROM (SELECT quantile_cont(g, 0.5) AS g FROM (
      SELECT (epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderdate)) // 86400000000 AS g FROM orders))"""
)
def frequency_label(spark, d):
    return ts.frequency_label(table(spark, d, "orders"), "o_orderdate", tie=["o_orderkey"])


@query(
    f"""SELECT o_custkey, {_LABEL_SQL} FROM (SELECT o_custkey, quantile_cont(g, 0.5) AS g FROM (
      SELECT o_custkey, (epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)) // 86400000000 AS g
      FROM orders) GROUP BY 1)"""
)
def frequency_label_by_customer(spark, d):
    return ts.frequency_label(table(spark, d, "orders"), "o_orderdate", ["o_custkey"], ["o_orderkey"])


@query(
    f"""WITH f AS ({_gap_code_sql("events", "ts", "event_type")})
    SELECT event_type, count(value) AS points, round(min(value), 4) AS "min", round(max(value), 4) AS "max", round(avg(value), 4) AS mean,
    round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS std, any_value(frequency) AS frequency
    FROM events JOIN f USING (event_type) GROUP BY event_type"""
)
def series_metrics(spark, d):
    return rounded(ts.series_metrics(table(spark, d, "events"), "ts", "value", ["event_type"]))


def _moving_sql(source: str, order: str, key: str | None, columns: str) -> str:
    part = f"PARTITION BY {key} " if key else ""
    averages = ", ".join(
        f"CASE WHEN p >= {w - 1} AND n > {w} AND n >= 10 THEN round(avg(value) OVER ({part}ORDER BY p ROWS {w - 1} PRECEDING), 4) END AS ma_{w}"
        for w in ts.MOVING_WINDOWS
    )
    return f"""SELECT {columns}, p AS position, round(value, 4) AS value, {averages} FROM (
      SELECT *, row_number() OVER ({part}ORDER BY {order}) - 1 AS p, count(*) OVER ({part}) AS n FROM {source})"""


@query(_moving_sql("events", "ts, event_id", "event_type", "event_type"))
def moving_averages(spark, d):
    rows = ts.moving_averages(table(spark, d, "events"), "ts", "value", ["event_type"], ["event_id"])
    return rounded(rows.drop("ts"))


@query(f"WITH {ORDER_DAYS_SQL} " + _moving_sql("order_days", "ts", None, "strftime(ts, '%Y-%m-%d') AS ts"))
def moving_averages_daily(spark, d):
    return rounded(_iso(ts.moving_averages(order_days(spark, d), "ts", "value"), "ts"))


@query(
    """WITH p AS (SELECT event_type, value, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n,
        avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    l AS (SELECT event_type, regr_slope(value, p) FILTER (p < 11) AS hs, regr_intercept(value, p) FILTER (p < 11) AS hi,
        regr_slope(value, p - n) FILTER (p >= n - 11) AS es, regr_intercept(value, p - n) FILTER (p >= n - 11) AS ei FROM p GROUP BY 1)
    SELECT event_type, p AS position, round(value, 4) AS value,
      round(CASE WHEN n < 11 THEN NULL WHEN p < 5 THEN hi + hs * p WHEN p >= n - 5 THEN ei + es * (p - n) ELSE m END, 4) AS trend
    FROM p JOIN l USING (event_type)"""
)
def smoothed_trend(spark, d):
    rows = ts.smoothed_trend(table(spark, d, "events"), "ts", "value", ["event_type"], ["event_id"])
    return rounded(rows.drop("ts"))


# Daily order values per priority: on many days a priority has no order, so the gaps are real.
_REGULAR_SQL = """priority_days AS (SELECT o_orderpriority, o_orderdate::DATE AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
g AS (SELECT o_orderpriority, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY))::DATE AS ts FROM priority_days GROUP BY 1),
j AS (SELECT o_orderpriority, g.ts, value AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY g.ts) - 1 AS idx
  FROM g LEFT JOIN priority_days USING (o_orderpriority, ts)),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER back AS bi, last_value(v IGNORE NULLS) OVER back AS bv,
  first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER ahead AS ai, first_value(v IGNORE NULLS) OVER ahead AS av FROM j
  WINDOW back AS (PARTITION BY o_orderpriority ORDER BY idx ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY o_orderpriority ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
reg AS (SELECT o_orderpriority, ts, idx, v IS NULL AS was_gap, CASE WHEN v IS NOT NULL THEN v ELSE bv + (av - bv) * (idx - bi) / (ai - bi) END AS value FROM b)"""


def _regular_orders(spark, d):
    orders = table(spark, d, "orders")
    return ts.regularize(ts.daily_series(orders, "o_orderdate", "o_totalprice", ["o_orderpriority"]), ["o_orderpriority"])


@query(f"WITH {_REGULAR_SQL} SELECT o_orderpriority, strftime(ts, '%Y-%m-%d') AS ts, idx, round(value, 4) AS value, was_gap FROM reg")
def regular_series(spark, d):
    return rounded(_iso(_regular_orders(spark, d), "ts"))


# Averages of interpolated cents often end in a half of the last digit shown, where the order of a sum decides
# about rounding; both sides move them off it by far less than that digit.
_OFF_HALF = 0.00001

_PARTS_SQL = f"""{_REGULAR_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n,
  avg(value) OVER (PARTITION BY o_orderpriority ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM reg),
u AS (SELECT *, CASE WHEN idx >= 3 AND idx < n - 3 THEN m END AS trend FROM t),
r AS (SELECT o_orderpriority, idx % 7 AS ph, avg(value - trend) AS raw FROM u WHERE trend IS NOT NULL GROUP BY ALL),
s AS (SELECT o_orderpriority, ph, raw - avg(raw) OVER (PARTITION BY o_orderpriority) AS seasonal FROM r),
parts AS (SELECT o_orderpriority, ts, idx, value, trend, seasonal, value - trend - seasonal AS residual
  FROM u JOIN s USING (o_orderpriority) WHERE ph = idx % 7)"""


@query(
    f"""WITH {_PARTS_SQL} SELECT o_orderpriority, strftime(ts, '%Y-%m-%d') AS ts, round(trend + {_OFF_HALF}, 3) AS trend, round(seasonal + {_OFF_HALF}, 3) + 0.0 AS seasonal,
    round(residual + {_OFF_HALF}, 3) + 0.0 AS residual, 'ok' AS status FROM parts"""
)
def decomposition(spark, d):
    parts = ts.decompose(_regular_orders(spark, d), ts.SEASON_LENGTH["D"], ["o_orderpriority"])
    moved = [(F.col(c) + _OFF_HALF).alias(c) for c in ("trend", "seasonal", "residual")]
    return rounded(_iso(parts, "ts").select("o_orderpriority", "ts", *moved, "status"), 3)


def _even_sql(source: str) -> str:
    """Centred average over 12 rows: half weights at both ends."""
    return f"""t AS (SELECT *, count(*) OVER () AS n, (sum(value) OVER (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
      + (lag(value, 6) OVER (ORDER BY idx) + lead(value, 6) OVER (ORDER BY idx)) / 2) / 12 AS m FROM {source}),
    u AS (SELECT *, CASE WHEN idx >= 6 AND idx < n - 6 THEN m END AS trend FROM t),
    s AS (SELECT idx % 12 AS ph, avg(value - trend) AS raw FROM u WHERE trend IS NOT NULL GROUP BY 1)"""


@query(
    f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1),
    reg AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS idx FROM m), {_even_sql("reg")}
    SELECT strftime(ts, '%Y-%m-%d') AS ts, round(trend, 3) AS trend, round(raw - (SELECT avg(raw) FROM s), 3) + 0.0 AS seasonal,
    round(value - trend - (raw - (SELECT avg(raw) FROM s)), 3) + 0.0 AS residual FROM u JOIN s ON ph = idx % 12"""
)
def decomposition_monthly(spark, d):
    regular = ts.regularize(order_months(spark, d), step="1 month")
    parts = ts.decompose(regular, ts.SEASON_LENGTH["M"])
    return rounded(_iso(parts, "ts").select("ts", "trend", "seasonal", "residual"), 3)


@query(
    f"""WITH {_PARTS_SQL} SELECT o_orderpriority, round(avg(abs(seasonal)) / avg(abs(value)), 6) AS seasonal_strength,
    avg(abs(seasonal)) / avg(abs(value)) > 0.1 AS has_seasonality FROM parts GROUP BY 1"""
)
def seasonal_strength(spark, d):
    parts = ts.decompose(_regular_orders(spark, d), ts.SEASON_LENGTH["D"], ["o_orderpriority"])
    return rounded(ts.seasonal_strength(parts, ["o_orderpriority"]), 6)


def _acf_sql() -> str:
    lags = union_all(
        [
            f"SELECT event_type, {k} AS lag, sum(d * p{k}) AS s, any_value(n) AS n FROM l GROUP BY 1"
            for k in range(ts.MAX_LAG + 1)
        ]
    )
    shifted = ", ".join(f"lag(d, {k}) OVER w AS p{k}" for k in range(ts.MAX_LAG + 1))
    return f"""c AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type) AS d, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    l AS (SELECT *, {shifted} FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    s AS ({lags}), acf AS (SELECT event_type, lag::BIGINT AS lag, CASE WHEN n > 10 THEN s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY event_type) END AS acf
      FROM s WHERE lag <= n // 2)"""


@query(f"WITH {_acf_sql()} SELECT event_type, lag, round(acf, 6) + 0.0 AS acf FROM acf")
def autocorrelation(spark, d):
    rows = ts.autocorrelation(table(spark, d, "events"), "ts", "value", ["event_type"], ["event_id"])
    return rounded(rows, 6)


@query()
def partial_autocorrelation(spark, d):
    rows = forecast.partial_autocorrelation(table(spark, d, "events"), "ts", "value", ["event_type"], ["event_id"])
    return rounded(rows, 6)


def _daily_acf_sql() -> str:
    lags = union_all(
        [f"SELECT event_type, {k} AS lag, sum(d * p{k}) AS s, any_value(n) AS n FROM l GROUP BY 1" for k in range(ts.MAX_LAG + 1)]
    )
    shifted = ", ".join(f"lag(d, {k}) OVER w AS p{k}" for k in range(ts.MAX_LAG + 1))
    return f"""{EVENT_DAYS_SQL},
    c AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type) AS d, count(*) OVER (PARTITION BY event_type) AS n FROM event_days),
    l AS (SELECT *, {shifted} FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    s AS ({lags}), acf AS (SELECT event_type, lag, CASE WHEN n > 10 THEN s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY event_type) END AS acf
      FROM s WHERE lag <= n // 2)"""


@query(
    f"""WITH {_daily_acf_sql()} SELECT event_type,
    coalesce(string_agg(lag::VARCHAR, ',' ORDER BY lag) FILTER (lag > 0 AND abs(acf) > 0.3), '') AS significant_lags,
    count(*) FILTER (lag > 0 AND abs(acf) > 0.3) > 0 AS has_autocorrelation FROM acf GROUP BY 1"""
)
def significant_lags(spark, d):
    acf = ts.autocorrelation(event_days(spark, d), "ts", "value", ["event_type"])
    found = ts.significant_lags(acf, ["event_type"])
    return found.withColumn("significant_lags", F.array_join(F.col("significant_lags").cast("array<string>"), ","))


@query(
    """SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1
      < floor(count(*) OVER (PARTITION BY event_type) * 0.8) THEN 'train' ELSE 'test' END AS part FROM events"""
)
def chronological_split(spark, d):
    parts = ts.chronological_split(table(spark, d, "events"), "ts", ["event_type"], ["event_id"])
    return parts.select("event_id", "part")


@query()
def arima_forecast(spark, d):
    return rounded(_iso(forecast.arima_forecast(event_days(spark, d), ["event_type"]), "ts"))


@query(
    """WITH p AS (SELECT event_type, value, lag(value) OVER w AS naive,
      avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean7
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    u AS (SELECT event_type, 'naive' AS method, value, naive AS f FROM p UNION ALL SELECT event_type, 'mean7', value, mean7 FROM p)
    SELECT event_type, method, count(*) AS n, round(avg(abs(value - f)), 5) AS mae, round(sqrt(avg(pow(value - f, 2))), 5) AS rmse,
      round(avg(abs((value - f) / nullif(value, 0))) * 100, 4) AS mape FROM u WHERE f IS NOT NULL GROUP BY ALL"""
)
def forecast_errors(spark, d):
    """Errors of the previous value and of the mean of the last seven as one-step forecasts."""
    placed = with_position(table(spark, d, "events").select("event_type", "ts", "event_id", "value"), ["ts", "event_id"], ["event_type"])
    guesses = lambda w: {"naive": F.lag("value").over(w), "mean7": F.avg("value").over(w.rowsBetween(-7, -1))}
    rows = over_neighbours(placed, guesses, before=7, keys=["event_type"])
    long = rows.select("event_type", "value", "naive", "mean7").unpivot(
        ["event_type", "value"], ["naive", "mean7"], "method", "forecast"
    )
    return rounded(forecast.forecast_errors(long, "value", "forecast", ["event_type", "method"]), 5, mape=4)


def _future_sql(code: str, step: str) -> str:
    return f"SELECT '{code}' AS code, i AS step, strftime({step}, '%Y-%m-%d %H:%M') AS ts FROM m, (SELECT unnest(range(1, 7)) AS i)"


@query(
    "WITH m AS (SELECT max(ts) AS t FROM events)\n"
    + union_all(
        [
            _future_sql("H", "t + i * INTERVAL 1 HOUR"),
            _future_sql("D", "t + i * INTERVAL 1 DAY"),
            _future_sql("W", "t + ((7 - isodow(t)) + 7 * (i - CASE WHEN isodow(t) = 7 THEN 0 ELSE 1 END)) * INTERVAL 1 DAY"),
            _future_sql("2W", "t + ((7 - isodow(t)) + 14 * (i - CASE WHEN isodow(t) = 7 THEN 0 ELSE 1 END)) * INTERVAL 1 DAY"),
            _future_sql("M", "last_day(t + (i - CASE WHEN t::DATE = last_day(t) THEN 0 ELSE 1 END) * INTERVAL 1 MONTH)::TIMESTAMP"),
        ]
    )
)
def future_dates(spark, d):
    events = table(spark, d, "events")
    result = None
    for code in ("H", "D", "W", "2W", "M"):
        part = forecast.future_dates(events, "ts", code).select(
            F.lit(code).alias("code"), F.col("step").cast("long").alias("step"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts")
        )
        result = part if result is None else result.unionByName(part)
    return result


def _nation_months(spark, d):
    """Monthly order values of every customer nation: many series of one length each."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return ts.daily_series(orders, "o_orderdate", "o_totalprice", ["c_nationkey"], grain="month")


_NATION_MONTHS_SQL = """nation_months AS (SELECT c_nationkey, date_trunc('month', o_orderdate)::DATE AS ts, sum(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query()
def holt_winters_forecast(spark, d):
    return rounded(forecast.holt_winters_forecast(_nation_months(spark, d), ["c_nationkey"]), 3)


@query(
    f"""WITH {_NATION_MONTHS_SQL}, n AS (SELECT c_nationkey, count(*) AS n FROM nation_months GROUP BY 1)
    SELECT c_nationkey, i AS step FROM n, (SELECT unnest(range(1, 7)) AS i) WHERE n >= 24
    UNION ALL SELECT c_nationkey, NULL FROM n WHERE n < 24"""
)
def holt_winters_horizon(spark, d):
    """Which steps every nation's series gets: six, or one row without a step where it is shorter than two years."""
    rows = forecast.holt_winters_forecast(_nation_months(spark, d), ["c_nationkey"])
    return rounded(rows.select("c_nationkey", "step"))


@query(
    f"""WITH RECURSIVE {_NATION_MONTHS_SQL},
    w AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY ts) - 1 AS i,
      (value - lag(value) OVER (PARTITION BY c_nationkey ORDER BY ts)) / 1e6 AS w FROM nation_months),
    k(c_nationkey, i, v, r, hat) AS (
      SELECT c_nationkey, 1, w, (1 + 2 * 0.5 * 0.3 + 0.09) / 0.75, 0.5 * w + 0.3 * w / ((1 + 2 * 0.5 * 0.3 + 0.09) / 0.75) FROM w WHERE i = 1
      UNION ALL SELECT c_nationkey, w.i, w - hat, 1.09 - 0.09 / r, 0.5 * w + 0.3 * (w - hat) / (1.09 - 0.09 / r)
      FROM k JOIN w USING (c_nationkey) WHERE w.i = k.i + 1)
    SELECT c_nationkey, count(*) AS n, round(-0.5 * sum(ln(2 * pi() * r) + v * v / r), 4) AS log_likelihood FROM k GROUP BY 1"""
)
def arima_likelihood(spark, d):
    """Exact likelihood of every nation's monthly changes under fixed parameters."""
    months = _nation_months(spark, d).withColumn("value", F.col("value") / 1e6)
    return rounded(forecast.arima_likelihood(months, 0.5, 0.3, 1.0, ["c_nationkey"]), 4)


def _broken_months(spark, d):
    """Monthly counts of days, turned into a line per nation that breaks after a number of months of its own."""
    months = _nation_months(spark, d).select("c_nationkey", "ts")
    first = months.groupBy("c_nationkey").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    dated = months.join(first, "c_nationkey")
    month = F.months_between("ts", "lo").cast("double")
    at = (F.months_between("hi", "lo") * (0.25 + F.col("c_nationkey") % 5 * 0.1)).cast("int")
    planted = dated.withColumn("at", at)
    value = 100 + 2.0 * month + 5.0 * F.greatest(F.lit(0.0), month - F.col("at"))
    return planted.select("c_nationkey", "ts", value.alias("value"), F.add_months("lo", F.col("at")).alias("break_day"))


@query(f"WITH {_NATION_MONTHS_SQL} SELECT c_nationkey, true AS found FROM nation_months GROUP BY 1 HAVING count(*) >= 24")
def trend_breaks(spark, d):
    """Lines with a planted break over every nation's months: whether the largest change of slope lies within a month of it."""
    series = _broken_months(spark, d)
    longer = series.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("break_day").alias("break_day")).where("n >= 24")
    found = changepoints.change_points(series, ["c_nationkey"], spec=changepoints.Trend(changes=50, waves=0))
    largest = found.groupBy("c_nationkey").agg(F.max_by("ts", "share").alias("largest"))
    joined = longer.join(largest, "c_nationkey", "left")
    near = F.abs(F.date_diff("largest", "break_day")) <= 31
    return rounded(joined.select("c_nationkey", F.coalesce(near, F.lit(False)).alias("found")))


@query()
def change_point_forecast(spark, d):
    return rounded(_iso(changepoints.change_point_forecast(_nation_months(spark, d), ["c_nationkey"]), "ts"), 0)


@query()
def trend_season_forecast(spark, d):
    return rounded(_iso(forecast.trend_season_forecast(_nation_months(spark, d), ["c_nationkey"]), "ts"), 2)


@query(
    f"""WITH {_NATION_MONTHS_SQL},
    p AS (SELECT c_nationkey, value, date_diff('day', min(ts) OVER (PARTITION BY c_nationkey), ts) / 365.25 AS t FROM nation_months),
    f AS (SELECT c_nationkey, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, sqrt(regr_syy(value, t) * (1 - regr_r2(value, t)) / count(*)) AS e
      FROM p GROUP BY 1),
    s AS (SELECT c_nationkey, min(ts) AS lo, max(ts) AS hi FROM nation_months GROUP BY 1),
    h AS (SELECT c_nationkey, i AS step, (hi + i * INTERVAL 1 MONTH)::DATE AS ts, lo FROM s, (SELECT unnest(range(1, 7)) AS i))
    SELECT c_nationkey, step, strftime(ts, '%Y-%m-%d') AS ts, round(a + b * date_diff('day', lo, ts) / 365.25, 1) AS forecast,
      round(a + b * date_diff('day', lo, ts) / 365.25 - 1.2816 * e, 1) AS lower_bound,
      round(a + b * date_diff('day', lo, ts) / 365.25 + 1.2816 * e, 1) AS upper_bound FROM h JOIN f USING (c_nationkey)"""
)
def trend_forecast(spark, d):
    """The forecast without seasonal waves, whose least squares SQL has too."""
    return rounded(_iso(forecast.trend_season_forecast(_nation_months(spark, d), ["c_nationkey"], order=0), "ts"), 1)


@query(
    """WITH p AS (SELECT event_type, value, ts, event_id, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events),
    c AS (SELECT *, value - b AS ch, (value / nullif(b, 0) - 1) * 100 AS pct FROM p),
    a AS (SELECT event_type, arg_min(value, (ts, event_id)) AS s, arg_max(value, (ts, event_id)) AS e, min(value) AS lo, max(value) AS hi,
      avg(ch) AS ac, avg(pct) AS ap, stddev_samp(pct) AS vol FROM c GROUP BY 1)
    SELECT event_type, round(s, 4) AS start_value, round(e, 4) AS end_value, round(lo, 4) AS min_value, round(hi, 4) AS max_value,
      round(e - s, 4) + 0.0 AS total_change, round((e / nullif(s, 0) - 1) * 100, 4) + 0.0 AS pct_total_change, round(ac, 6) + 0.0 AS avg_change,
      round(ap, 4) + 0.0 AS avg_pct_change, round(vol, 4) AS volatility FROM a"""
)
def change_metrics(spark, d):
    rows = ts.change_metrics(table(spark, d, "events"), "ts", "value", ["event_type"], ["event_id"])
    return rounded(rows, 4, avg_change=6)


_QUALITY_SQL = "CASE WHEN n < 10 THEN 'Poor' WHEN n < 30 THEN 'Fair' WHEN n < 100 THEN 'Good' ELSE 'Excellent' END"


@query(f"SELECT o_custkey, n AS data_points, {_QUALITY_SQL} AS quality FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def forecast_readiness(spark, d):
    return ts.forecast_readiness(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_custkey"])


@query(
    f"""WITH a(quality, model, suitability, complexity) AS (VALUES {", ".join(str(r) for r in ts.MODEL_ADVICE)})
    SELECT o_custkey, n AS data_points, quality, model, suitability, complexity FROM (
      SELECT o_custkey, n, {_QUALITY_SQL} AS quality FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) JOIN a USING (quality)"""
)
def suggested_models(spark, d):
    ready = ts.forecast_readiness(table(spark, d, "orders"), "o_orderdate", None, ["o_custkey"])
    return ts.suggest_models(ready)


@query(
    f"""WITH h(l, short_term, medium_term, long_term, recommendation) AS (VALUES {", ".join(str(r) for r in ts.HORIZONS)}),
    s AS (SELECT o_custkey, count(*) AS n, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM orders GROUP BY 1)
    SELECT o_custkey, span_days, short_term, medium_term, long_term, recommendation FROM (
      SELECT *, CASE WHEN n < 2 THEN 'none' WHEN span_days < 30 THEN 'month' WHEN span_days < 365 THEN 'year' ELSE 'longer' END AS l FROM s)
    JOIN h USING (l)"""
)
def forecast_horizon(spark, d):
    return ts.forecast_horizon(table(spark, d, "orders"), "o_orderdate", ["o_custkey"])


@query(
    """WITH g AS (SELECT o_custkey, o_orderdate, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate) AS g FROM orders),
    s AS (SELECT o_custkey, count(*) AS n, max(g) AS g FROM g GROUP BY 1),
    f AS (SELECT *, (n < 30)::INT + coalesce(g > 30, false)::INT + (n < 365)::INT AS found FROM s)
    SELECT o_custkey, concat_ws('; ', CASE WHEN n < 30 THEN 'Limited historical data points' END,
      CASE WHEN g > 30 THEN 'Large gaps in time series (max gap: ' || g || ' days)' END,
      CASE WHEN n < 365 THEN 'Insufficient data to capture annual seasonality' END,
      CASE WHEN found < 2 THEN 'Standard forecasting uncertainty applies' END) AS limitations FROM f"""
)
def forecast_limitations(spark, d):
    rows = ts.forecast_limitations(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_custkey"])
    return rows.withColumn("limitations", F.array_join("limitations", "; "))


@query(
    """WITH p AS (SELECT event_type, value AS y, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400e6 AS x FROM events),
    f AS (SELECT event_type, count(*) AS points, regr_slope(y, x) AS b, regr_r2(y, x) AS r FROM p GROUP BY 1)
    SELECT event_type, points, round(b, 6) + 0.0 AS slope_per_day, round(r, 6) AS r2,
      CASE WHEN r >= 0.5 THEN 'Strong' WHEN r >= 0.2 THEN 'Moderate' ELSE 'Weak' END AS strength,
      CASE WHEN b > 0 THEN 'Upward' WHEN b < 0 THEN 'Downward' ELSE 'Flat' END AS direction FROM f"""
)
def trend_summary(spark, d):
    return rounded(ts.trend_summary(table(spark, d, "events"), "ts", "value", ["event_type"]), 6)


@query(
    f"""WITH g(analysis, least) AS (VALUES {", ".join(str(r) for r in ts.MIN_POINTS.items())}),
    c AS (SELECT o_custkey, count(*) AS points FROM orders GROUP BY 1)
    SELECT o_custkey, points, analysis, CASE WHEN points >= least THEN 'ok' ELSE 'not enough points' END AS status FROM c CROSS JOIN g"""
)
def analysis_gates(spark, d):
    return ts.analysis_gates(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_custkey"])


