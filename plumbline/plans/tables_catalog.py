"""Queries on sources, sinks, schema, quality and cleaning."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scratch import materialize, scratch_path
from plumbline.operators import clean, modeling, quality, report, schema
from plumbline.plans.registry import query, rounded, union_all
from plumbline.plans.views import SALES_SQL, SOILED_SQL, sales, soiled_orders, table
from plumbline.sources.readers import read_table
from plumbline.sources.workbooks import parse_workbooks
from plumbline.sources.writers import write_csv, write_encoding_maps
from plumbline.streaming.watch import watch_folder

ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def _order_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey").cast("long"),
        F.col("o_custkey").cast("long"),
        "o_orderstatus",
        F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )


# ---------------------------------------------------------------- sources and sinks


@query(ORDERS_SQL)
def csv_scan(spark, d):
    path = scratch_path(spark, "orders") + ".csv"
    write_csv(table(spark, d, "orders"), path)
    return _order_rows(read_table(spark, path))


@query(ORDERS_SQL)
def json_records_scan(spark, d):
    o = table(spark, d, "orders").withColumn("chunk", F.floor(F.col("o_orderkey") / 1000))
    record = F.struct(*[c for c in o.columns if c != "chunk"])
    arrays = o.groupBy("chunk").agg(F.to_json(F.collect_list(record)).alias("value")).select("value")
    path = scratch_path(spark, "orders") + ".jsonl"
    arrays.write.text(path)
    return _order_rows(read_table(spark, path))


@query(ORDERS_SQL)
def json_array_scan(spark, d):
    """The same records as files that each hold one array of objects."""
    o = table(spark, d, "orders").withColumn("chunk", F.floor(F.col("o_orderkey") / 1000))
    record = F.struct(*[c for c in o.columns if c != "chunk"])
    arrays = o.groupBy("chunk").agg(F.to_json(F.collect_list(record)).alias("value"))
    path = scratch_path(spark, "orders") + ".json"
    arrays.write.partitionBy("chunk").text(path)
    return _order_rows(read_table(spark, path))


_WORKBOOK_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
}


def _sheet_cell(ref: str, v) -> str:
    if isinstance(v, pd.Timestamp):
        serial = (v - pd.Timestamp("1899-12-30")) / pd.Timedelta(days=1)
        return f'<c r="{ref}" s="1"><v>{serial!r}</v></c>'
    if isinstance(v, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    if v is not None and v == v:
        return f'<c r="{ref}"><v>{v!r}</v></c>'.replace("np.float64(", "").replace(")<", "<")
    return ""


def _sheet_column(letter: str, values: pd.Series) -> list[str]:
    """Cells of a column below the header, from row 2 on; columns of one plain type are written without a look at each value."""
    if values.dtype.kind == "M" and not getattr(values.dtype, "tz", None):
        day = 86_400_000_000_000
        epoch = pd.Timestamp("1899-12-30").as_unit("ns").value
        stamps = values.astype("datetime64[ns]").astype("int64").tolist()
        known = values.notna().tolist()
        return [f'<c r="{letter}{i}" s="1"><v>{(v - epoch) / day!r}</v></c>' if k else "" for i, (v, k) in enumerate(zip(stamps, known), 2)]
    if values.dtype.kind in "iu":
        return [f'<c r="{letter}{i}"><v>{v}</v></c>' for i, v in enumerate(values.tolist(), 2)]
    if values.dtype.kind == "f":
        return [f'<c r="{letter}{i}"><v>{v!r}</v></c>' if v == v else "" for i, v in enumerate(values.tolist(), 2)]
    return [_sheet_cell(f"{letter}{i}", v) for i, v in enumerate(values, 2)]


def workbook_bytes(rows: pd.DataFrame) -> bytes:
    """A small workbook; datetime columns become date-styled serial numbers."""
    letters = [chr(65 + i) for i in range(len(rows.columns))]
    header = [_sheet_cell(f"{letter}1", name) for letter, name in zip(letters, rows.columns)]
    columns = [_sheet_column(letter, rows.iloc[:, i]) for i, letter in enumerate(letters)]
    lines = [f"<row>{''.join(cells)}</row>" for cells in (header, *zip(*columns))]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _WORKBOOK_PARTS.items():
            book.writestr(name, text)
        book.writestr("xl/worksheets/sheet1.xml", sheet + "".join(lines) + "</sheetData></worksheet>")
    return out.getvalue()


@query(ORDERS_SQL)
def workbook_scan(spark, d):
    """Orders packed into workbooks of 2,000 order keys each, then read back as one table."""
    o = table(spark, d, "orders").withColumn("chunk", F.floor(F.col("o_orderkey") / 2000))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        name = f"orders-{rows['chunk'].iloc[0]}.xlsx"
        return pd.DataFrame({"path": [name], "content": [workbook_bytes(rows.drop(columns="chunk"))]})

    files = o.groupBy("chunk").applyInPandas(pack, "path string, content binary")
    return _order_rows(parse_workbooks(materialize(files)))


@query(
    """SELECT ext, count(*) AS n, round(sum(s_acctbal), 2) AS balance
    FROM supplier CROSS JOIN (VALUES ('csv'), ('jsonl'), ('orc'), ('parquet')) AS x(ext) GROUP BY ext"""
)
def format_dispatch(spark, d):
    s = table(spark, d, "supplier")
    result = None
    for ext in ("csv", "jsonl", "orc", "parquet"):
        path = scratch_path(spark, "supplier") + f".{ext}"
        if ext == "csv":
            write_csv(s, path)
        else:
            s.write.format({"jsonl": "json"}.get(ext, ext)).save(path)
        part = read_table(spark, path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
        part = part.withColumn("ext", F.lit(ext))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    union_all(
        [
            f"SELECT 'orders.parquet' AS file, '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing, {m} AS mean FROM orders"
            for c, m in [
                ("o_orderkey", "round(avg(o_orderkey), 4)"),
                ("o_custkey", "round(avg(o_custkey), 4)"),
                ("o_orderstatus", "NULL::DOUBLE"),
                ("o_totalprice", "round(avg(o_totalprice), 4)"),
                ("o_orderdate", "NULL::DOUBLE"),
                ("o_orderpriority", "NULL::DOUBLE"),
            ]
        ]
    )
)
def folder_watch(spark, d):
    results, state = scratch_path(spark, "watch"), scratch_path(spark, "watch-state")
    stream = watch_folder(
        spark, d, table(spark, d, "orders").schema, results, state, "parquet", pattern="orders.parquet"
    )
    stream.awaitTermination()
    found = spark.read.parquet(results)
    name = F.regexp_extract("file", "([^/]+)$", 1)
    return rounded(found.select(name.alias("file"), "column", F.col("rows").alias("n"), "missing", "mean"))


_CLEANED_SQL = f"""{SOILED_SQL},
once AS (SELECT DISTINCT o_orderkey, price, priority, ordered, status FROM soiled),
med AS (SELECT quantile_cont(price, 0.5) AS m FROM once),
top AS (SELECT priority AS p FROM once WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)"""


@query(
    f"""WITH {_CLEANED_SQL}
    SELECT o_orderkey, round(coalesce(price, m), 4) AS price, coalesce(priority, p) AS priority,
           strftime(ordered, '%Y-%m-%d') AS ordered, status FROM once, med, top"""
)
def cleaned_table_csv(spark, d):
    rows = clean.drop_sparse_columns(clean.drop_duplicate_rows(soiled_orders(spark, d)))
    cleaned = clean.impute_mode(clean.impute_median(rows, ["price"]), ["priority", "status"])
    path = scratch_path(spark, "cleaned") + ".csv"
    write_csv(cleaned, path)
    back = read_table(spark, path, cleaned.schema)
    return rounded(back.withColumn("ordered", F.date_format("ordered", "yyyy-MM-dd")))


@query(
    union_all(
        [
            f"SELECT '{c}' AS \"column\", v AS value, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM {t})"
            for c, t in [("p_type", "part"), ("p_brand", "part"), ("p_name", "part")]
        ]
    )
)
def encoding_map_table(spark, d):
    stored = write_encoding_maps(
        table(spark, d, "part"), ["p_type", "p_brand", "p_name"], scratch_path(spark, "encoding")
    )
    return stored.select("column", "value", F.col("code").cast("long").alias("code"))


@query("SELECT 'orders' AS source, count(*) AS n, 6::BIGINT AS columns FROM orders")
def run_metadata_row(spark, d):
    return report.run_metadata(table(spark, d, "orders"), "orders", with_time=False).withColumnRenamed("rows", "n")


# ---------------------------------------------------------------- schema and profile

_EVENT_ROLES = [
    ("event_id", "bigint", "numeric"),
    ("ts", "timestamp_ntz", "datetime"),
    ("user_id", "bigint", "numeric"),
    ("event_type", "string", "categorical"),
    ("value", "double", "numeric"),
    ("props", "string", "categorical"),
]


def _text_role(column: str) -> str:
    return (
        f"(SELECT CASE WHEN count({column}) > 0 AND count({column}) = count(TRY_CAST({column} AS TIMESTAMP)) "
        f"THEN 'datetime' ELSE 'categorical' END FROM source)"
    )


@query(
    "WITH source AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events)\n"
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, "
            + (_text_role(c) if t == "string" else f"'{r}'")
            + " AS role"
            for c, t, r in [*_EVENT_ROLES, ("ts_text", "string", "datetime")]
        ]
    )
)
def column_roles(spark, d):
    e = table(spark, d, "events")
    return schema.column_roles(e.withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


# Text columns made from the orders' dates, and whether they are dates: codes, years and mixed forms are not.
_DATE_TEXTS = {
    "us": "MM/dd/yyyy", "short_us": "M/d/yyyy h:mm a", "slashed": "yyyy/MM/dd", "named": "MMM d, yyyy", "full": "d MMMM yyyy",
    "dashed": "dd-MMM-yyyy", "packed": "yyyyMMdd", "dotted": "dd.MM.yyyy", "european": "dd/MM/yyyy HH:mm:ss", "iso": "yyyy-MM-dd'T'HH:mm:ss",
}


@query(
    "WITH d AS (SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders)\n"
    + union_all(
        [f"SELECT '{c}' AS \"column\", 'datetime' AS role, first_day, last_day FROM d" for c in _DATE_TEXTS]
        + [f"SELECT '{c}', 'categorical', NULL, NULL" for c in ("year", "postcode", "mixed")]
    )
)
def text_date_roles(spark, d):
    """Roles of text in the usual forms of dates, and the first and last day that they are read as."""
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    texts = [F.date_format(day, pattern).alias(c) for c, pattern in _DATE_TEXTS.items()]
    mixed = F.when(F.dayofmonth(day) > 15, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    codes = [F.year(day).cast("string").alias("year"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0").alias("postcode"), mixed.alias("mixed")]
    soiled = o.select(*texts, *codes)
    roles = schema.classify(soiled)
    read = schema.apply_roles(soiled, roles)
    span = lambda f, c: F.date_format(f(c), "yyyy-MM-dd") if c in roles.datetime else F.lit(None).cast("string")
    row = read.agg(*[F.struct(span(F.min, c).alias("first_day"), span(F.max, c).alias("last_day")).alias(c) for c in soiled.columns])
    kinds = [
        F.struct(F.lit(c).alias("column"), F.lit("datetime" if c in roles.datetime else "categorical").alias("role"), F.col(c)["first_day"].alias("first_day"), F.col(c)["last_day"].alias("last_day"))
        for c in soiled.columns
    ]
    return schema.one_row_to_long(row, kinds)


@query(
    union_all(
        [
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
            f"{sum(x[1] == t for x in _EVENT_ROLES)}::BIGINT AS same_dtype_columns FROM events"
            for c, t, _ in _EVENT_ROLES
        ]
    )
)
def dtype_profile(spark, d):
    return schema.dtype_profile(table(spark, d, "events"))


@query(
    """SELECT event_id, strftime(TRY_CAST(CASE WHEN event_type = 'error' THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
    AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed FROM events"""
)
def parse_timestamps(spark, d):
    text = F.when(F.col("event_type") == "error", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = schema.parse_timestamps(table(spark, d, "events").withColumn("text", text), "text", "parsed")
    return parsed.select("event_id", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


_SOILED_COLUMNS = ["o_orderkey", "price", "priority", "ordered", "sparse", "status"]


@query(
    f"WITH {SOILED_SQL}\n"
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM soiled"
            for c in _SOILED_COLUMNS
        ]
    )
)
def missing_summary(spark, d):
    return quality.missing_summary(soiled_orders(spark, d))


_MISSING_TOTAL = " + ".join(f"(count(*) - count({c}))" for c in _SOILED_COLUMNS)


@query(
    f"""WITH {SOILED_SQL} SELECT count(*) AS n, 6::BIGINT AS columns, {_MISSING_TOTAL} AS missing,
    round(({_MISSING_TOTAL}) * 100.0 / (count(*) * 6), 2) AS missing_pct FROM soiled"""
)
def missing_totals(spark, d):
    return quality.missing_totals(soiled_orders(spark, d)).withColumnRenamed("rows", "n")


_COPIES = "(SELECT count(*) FROM soiled) - (SELECT count(*) FROM (SELECT DISTINCT * FROM soiled))"


@query(
    f"""WITH {SOILED_SQL} SELECT count(*) AS n, {_COPIES} AS duplicates,
    round(({_COPIES}) * 100.0 / count(*), 2) AS duplicate_pct FROM soiled"""
)
def duplicate_rows(spark, d):
    return quality.duplicate_summary(soiled_orders(spark, d)).withColumnRenamed("rows", "n")


@query(
    f"""WITH {SOILED_SQL}, s AS (SELECT count(*) AS n, 100 - ({_MISSING_TOTAL}) * 100.0 / (count(*) * 6) AS c,
      100 - ({_COPIES}) * 100.0 / count(*) AS u FROM soiled)
    SELECT n, 6::BIGINT AS columns, round(c, 4) AS completeness_score, round(u, 4) AS uniqueness_score,
      round((c + u) / 2, 4) AS quality_score FROM s"""
)
def quality_score(spark, d):
    return quality.quality_score(soiled_orders(spark, d)).withColumnRenamed("rows", "n")


@query(
    f"WITH {SOILED_SQL}, issues AS ("
    + union_all(
        [
            f"SELECT 'missing_values' AS issue_type, '{c}' AS \"column\", count(*) - count({c}) AS n, count(*) AS total, "
            "'May affect analysis accuracy' AS impact, 'Consider imputation or filtering' AS recommendation FROM soiled"
            for c in _SOILED_COLUMNS
        ]
        + [
            f"SELECT 'duplicate_rows', NULL, {_COPIES}, count(*), 'May skew analysis results', "
            "'Remove duplicates before analysis' FROM soiled"
        ]
    )
    + ') SELECT issue_type, "column", n, round(n * 100.0 / total, 4) AS percentage, impact, recommendation FROM issues WHERE n > 0'
)
def quality_issues(spark, d):
    return quality.quality_issues(soiled_orders(spark, d)).withColumnRenamed("count", "n")


@query(f"WITH {SOILED_SQL} SELECT price, priority FROM soiled WHERE price IS NOT NULL AND priority IS NOT NULL")
def complete_pairs(spark, d):
    return schema.complete_rows(soiled_orders(spark, d), ["price", "priority"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'")
def rows_of_one_value(spark, d):
    return schema.rows_where_equal(table(spark, d, "orders"), "o_orderpriority", "2-HIGH").select(
        "o_orderkey", "o_totalprice"
    )


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def rows_of_every_value(spark, d):
    return schema.value_row_counts(table(spark, d, "orders"), "o_orderpriority")


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net,
    round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem"""
)
def derived_columns(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    new = {"net": net, "charge": net * (1 + F.col("l_tax"))}
    wide = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return rounded(schema.derive_columns(wide, new, ["l_extendedprice", "l_discount", "l_tax"]), 6)


@query(
    """SELECT p_partkey, p_type, p_size > 25 AS large, (p_type = 'PROMO')::BIGINT AS is_promo, length(p_name) AS name_length
    FROM part"""
)
def side_by_side_columns(spark, d):
    """Aligned tables next to each other: projections of the same row, no join."""
    left = table(spark, d, "part")
    wide = left.select(
        "p_partkey",
        "p_type",
        (F.col("p_size") > 25).alias("large"),
        (F.col("p_type") == "PROMO").cast("long").alias("is_promo"),
        F.length("p_name").cast("long").alias("name_length"),
    )
    return wide


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values(spark, d):
    return schema.distinct_values(table(spark, d, "part"), "p_brand")


_LINE_TEXT = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey"]


@query(
    union_all([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in _LINE_TEXT])
)
def distinct_counts(spark, d):
    return schema.distinct_counts(table(spark, d, "lineitem"), _LINE_TEXT)


# ---------------------------------------------------------------- cleaning and encoding


@query(f"WITH {SOILED_SQL} SELECT DISTINCT o_orderkey, price, priority, sparse, status FROM soiled")
def drop_duplicates(spark, d):
    return clean.drop_duplicate_rows(soiled_orders(spark, d)).drop("ordered")


@query(f"WITH {SOILED_SQL} SELECT o_orderkey, price, priority, strftime(ordered, '%Y-%m-%d') AS ordered, status FROM soiled")
def drop_sparse_columns(spark, d):
    kept = clean.drop_sparse_columns(soiled_orders(spark, d))
    return kept.withColumn("ordered", F.date_format("ordered", "yyyy-MM-dd"))


@query(
    f"""WITH {SOILED_SQL}, m AS (SELECT quantile_cont(price, 0.5) AS m FROM soiled)
    SELECT o_orderkey, round(coalesce(price, m), 4) AS price FROM soiled, m"""
)
def impute_median(spark, d):
    return rounded(clean.impute_median(soiled_orders(spark, d), ["price"]).select("o_orderkey", "price"))


@query(
    f"""WITH {SOILED_SQL},
    a AS (SELECT priority AS v FROM soiled WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    b AS (SELECT sparse AS w FROM soiled WHERE sparse IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, coalesce(priority, v) AS priority, coalesce(sparse, w) AS sparse FROM soiled, a, b"""
)
def impute_mode(spark, d):
    filled = clean.impute_mode(soiled_orders(spark, d), ["priority", "sparse"])
    return filled.select("o_orderkey", "priority", "sparse")


@query(
    f"""WITH {SOILED_SQL}, once AS (SELECT DISTINCT o_orderkey, ordered FROM soiled)
    SELECT o_orderkey, strftime(coalesce(ordered,
      last_value(ordered IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(ordered IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), '%Y-%m-%d') AS ordered FROM once"""
)
def impute_dates(spark, d):
    rows = soiled_orders(spark, d).select("o_orderkey", "ordered").distinct()
    filled = clean.impute_dates(rows, ["ordered"], ["o_orderkey"])
    return filled.withColumn("ordered", F.date_format("ordered", "yyyy-MM-dd"))


@query(
    f"""WITH {SOILED_SQL}, once AS (SELECT DISTINCT o_orderkey, status, ordered FROM soiled)
    SELECT o_orderkey, status, strftime(coalesce(ordered,
      last_value(ordered IGNORE NULLS) OVER (PARTITION BY status ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(ordered IGNORE NULLS) OVER (PARTITION BY status ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), '%Y-%m-%d') AS ordered FROM once"""
)
def impute_dates_by_key(spark, d):
    rows = soiled_orders(spark, d).select("o_orderkey", "status", "ordered").distinct()
    filled = clean.impute_dates(rows, ["ordered"], ["o_orderkey"], ["status"])
    return filled.withColumn("ordered", F.date_format("ordered", "yyyy-MM-dd"))


@query(
    f"""WITH {SOILED_SQL}, m AS (SELECT avg(price) AS m FROM soiled)
    SELECT o_orderkey, round(coalesce(price, m), 3) AS price FROM soiled, m"""
)
def impute_mean(spark, d):
    return rounded(clean.impute_mean(soiled_orders(spark, d), ["price"]).select("o_orderkey", "price"), 3)


@query(
    f"""WITH {SOILED_SQL}, t AS (SELECT o_orderkey, coalesce(priority, 'nan') AS p, status FROM soiled)
    SELECT o_orderkey, dense_rank() OVER (ORDER BY p) - 1 AS priority_encoded,
           dense_rank() OVER (ORDER BY status) - 1 AS status_encoded FROM t"""
)
def label_encode(spark, d):
    encoded = clean.encode(soiled_orders(spark, d), ["priority", "status"], "label", null_label="nan")
    return encoded.select("o_orderkey", "priority_encoded", "status_encoded")


@query(
    f"""WITH {SOILED_SQL}, f AS (SELECT priority, min(o_orderkey) AS k FROM soiled WHERE priority IS NOT NULL GROUP BY 1),
    c AS (SELECT priority, row_number() OVER (ORDER BY k, priority) - 1 AS code FROM f)
    SELECT o_orderkey, code AS priority_encoded FROM soiled LEFT JOIN c USING (priority)"""
)
def first_seen_encode(spark, d):
    encoded = clean.encode(soiled_orders(spark, d), ["priority"], "first_seen", ["o_orderkey"])
    return encoded.select("o_orderkey", "priority_encoded")


@query(
    """WITH v AS (SELECT 'p_type' AS c, p_type AS v, p_partkey AS k FROM part UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part
      UNION ALL SELECT 'p_name', p_name, p_partkey FROM part),
    g AS (SELECT c, v, min(k) AS k FROM v GROUP BY ALL)
    SELECT c AS "column", v AS value, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS code, 'label' AS method FROM g
    UNION ALL SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY k, v) - 1, 'first_seen' FROM g"""
)
def chosen_encoder(spark, d):
    """The codes of both encoders; the caller names the one to use."""
    p = table(spark, d, "part")
    columns = ["p_type", "p_brand", "p_name"]
    label, seen = clean.label_codes(p, columns), clean.first_seen_codes(p, columns, ["p_partkey"])
    both = label.withColumn("method", F.lit("label")).unionByName(seen.withColumn("method", F.lit("first_seen")))
    return both.select("column", "value", "code", "method")


_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "SELECT p_partkey, "
    + ", ".join(f"CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END::BIGINT AS \"p_type_{t}\"" for t in _PART_TYPES)
    + " FROM part"
)
def one_hot_dummies(spark, d):
    wide = clean.one_hot_columns(table(spark, d, "part").select("p_partkey", "p_type", "p_name"), ["p_type", "p_name"], 20)
    return rounded(wide.drop("p_type", "p_name"))


@query(
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS hot_index, 1::BIGINT AS ones FROM part"""
)
def one_hot_vectors(spark, d):
    """Sparse indicator vectors for a column of any width; shown by position and number of ones."""
    from pyspark.ml.functions import vector_to_array

    wide = clean.one_hot_vectors(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])
    hot = vector_to_array("p_brand_onehot")
    return wide.select(
        "p_partkey",
        (F.array_position(hot, 1.0) - 1).cast("long").alias("hot_index"),
        F.aggregate(hot, F.lit(0.0), lambda s, v: s + v).cast("long").alias("ones"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 5) + 0.0 AS l_quantity_scaled,
    round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 5) + 0.0 AS l_extendedprice_scaled FROM lineitem"""
)
def standardize(spark, d):
    scaled = clean.standardize(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(scaled.select("l_orderkey", "l_linenumber", "l_quantity_scaled", "l_extendedprice_scaled"), 5)


@query(
    f"""WITH {_CLEANED_SQL},
    before AS (SELECT count(*) AS n, {_MISSING_TOTAL} AS m, round((count(*) - count(sparse)) * 100.0 / count(*), 2) AS s FROM soiled),
    after AS (SELECT count(*) AS n, count(*) - count(ordered) AS m, count(DISTINCT coalesce(priority, p)) AS c FROM once, top)
    SELECT 'rows_before' AS step, NULL AS subject, n::DOUBLE AS value FROM before
    UNION ALL SELECT 'rows_after', NULL, n FROM after
    UNION ALL SELECT 'duplicates_removed', NULL, before.n - after.n FROM before, after
    UNION ALL SELECT 'duplicate_pct', NULL, round((before.n - after.n) * 100.0 / before.n, 2) FROM before, after
    UNION ALL SELECT 'missing_before', NULL, m FROM before
    UNION ALL SELECT 'missing_after', NULL, m FROM after
    UNION ALL SELECT 'missing_imputed', NULL, before.m - after.m FROM before, after
    UNION ALL SELECT 'dropped_column', 'sparse', s FROM before
    UNION ALL SELECT 'encoded_column', 'priority', c FROM after"""
)
def cleaning_summary(spark, d):
    before = soiled_orders(spark, d)
    rows = clean.drop_sparse_columns(clean.drop_duplicate_rows(before))
    after = clean.encode(clean.impute_mode(clean.impute_median(rows, ["price"]), ["priority"]), ["priority"])
    return clean.cleaning_summary(before, after, ["priority"])


# ---------------------------------------------------------------- sorts and limits


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def sort_by_date(spark, d):
    from plumbline.functions.ordered import with_position

    placed = with_position(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return placed.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("_position").alias("position")
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def first_k_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(
    f"WITH {SALES_SQL} SELECT market, count(*) AS n, round(avg(price), 2) AS mean_price FROM sales GROUP BY market ORDER BY n DESC, market"
)
def sorted_results(spark, d):
    by_market = sales(spark, d, "market", "price").groupBy("market")
    return by_market.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 2).alias("mean_price")).orderBy(
        F.desc("n"), "market"
    )


@query("SELECT 'p_retailprice' AS target, count(DISTINCT p_retailprice) AS distinct_values FROM part")
def target_choice(spark, d):
    p = table(spark, d, "part")
    target = modeling.choose_target(p.columns, schema.classify(p).numeric)
    return p.agg(F.count_distinct(target).alias("distinct_values")).select(F.lit(target).alias("target"), "distinct_values")
