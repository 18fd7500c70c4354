import io
import json
import math
import os
import zipfile
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import associate, clean, describe, quality, schema
from plumbline.plans.tables_catalog import workbook_bytes
from plumbline.sources import workbooks
from plumbline.sources.readers import read_json, read_table
from plumbline.sources.workbooks import workbook_rows
from plumbline.streaming.watch import poll_folder, watch_folder


@pytest.fixture(scope="module")
def dirty(spark):
    pdf = pd.DataFrame(
        {
            "id": [1, 2, 3, 4, 5, 6, 6],
            "x": [1.0, np.nan, 3.0, 10.0, np.nan, 4.0, 4.0],
            "c": ["b", "a", None, "b", "a", None, None],
            "d": [None, datetime(2024, 1, 2), None, datetime(2024, 1, 4), None, None, None],
            "empty": [None, None, None, "z", None, None, None],
        }
    )
    plain = lambda v: None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    rows = [tuple(plain(v) for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, x double, c string, d timestamp_ntz, empty string")


def test_roles_and_missing(dirty):
    roles = schema.classify(dirty)
    assert roles.numeric == ("id", "x") and roles.datetime == ("d",) and roles.categorical == ("c", "empty")
    missing = {r["column"]: r["missing"] for r in quality.missing_summary(dirty).collect()}
    assert missing == {"id": 0, "x": 2, "c": 3, "d": 5, "empty": 6}
    assert quality.duplicate_summary(dirty).first()["duplicates"] == 1


def test_text_dates_are_recognised(frame):
    df = frame({"a": ["2024-01-05", None, "2024-02-01"], "b": ["2024-01-05", "soon", "x"]}, "a string, b string")
    assert schema.classify(df).datetime == ("a",)
    codes = frame({"zip": ["94107", "10001"], "month": ["2024-01", "2024-02"], "time": ["10:30", None]}, "zip string, month string, time string")
    assert schema.classify(codes).datetime == ("month",)
    assert schema.classify(codes).categorical == ("zip", "time")
    assert schema.apply_roles(df, schema.classify(df)).schema["a"].dataType.typeName() == "timestamp"


def test_quoted_line_ends_stay_in_their_field(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note\n1,"two\nlines"\n2,"a ""quote"""\n')
    rows = [tuple(r) for r in read_table(spark, str(tmp_path / "t.csv")).orderBy("id").collect()]
    assert rows == [(1, "two\nlines"), (2, 'a "quote"')]


def test_joint_frequency_of_four_columns(frame):
    df = frame({"a": ["x", "x"], "b": ["y", "y"], "c": ["z", "z"], "d": ["1", "2"]}, "a string, b string, c string, d string")
    got = associate.joint_frequency(df, ["a", "b", "c", "d"])
    assert got.columns == ["a", "b", "c", "d", "n"] and [r["n"] for r in got.collect()] == [1, 1]


def test_nan_counts_as_missing(frame):
    df = frame({"x": [1.0, float("nan"), None]}, "x double")
    assert quality.missing_summary(df).first()["missing"] == 2
    assert describe.numeric_describe(df, ["x"]).first()["count"] == 1


def test_clean(dirty):
    got = clean.clean(dirty, ["x"], ["c"], ["d"], ["id"], missing_threshold=0.4, encoding="label").toPandas().sort_values("id")
    assert "empty" not in got and "d" not in got  # both mostly missing
    assert got["x"].tolist() == [1, 3.5, 3, 10, 3.5, 4]
    assert got["c"].tolist() == ["b", "a", "a", "b", "a", "a"]  # a tie goes to the smaller value
    assert got["c_encoded"].tolist() == [1, 0, 0, 1, 0, 0]


def test_threshold_is_strict(frame):
    df = frame({"a": [1, None, 3, 4, 5, 6, 7, 8, 9, 10], "b": list(range(10))}, "a int, b int")
    assert clean.sparse_columns(df, 0.1) == []
    assert clean.sparse_columns(df, 0.09) == ["a"]


def test_encoders(dirty):
    codes = {r["value"]: r["code"] for r in clean.first_seen_codes(dirty, ["c"], ["id"]).collect()}
    assert codes == {"b": 0, "a": 1}
    labels = {r["value"]: r["code"] for r in clean.label_codes(dirty, ["c"], null_label="nan").collect()}
    assert labels == {"a": 0, "b": 1, "nan": 2}
    with pytest.raises(ValueError):
        clean.encode(dirty, ["c"], "other")


def test_date_fill(dirty):
    filled = clean.impute_dates(dirty.select("id", "d").distinct(), ["d"], ["id"]).toPandas().sort_values("id")
    assert [d.day for d in filled["d"]] == [2, 2, 2, 4, 4, 4]
    nothing = dirty.select("id", F.lit(None).cast("timestamp").alias("d")).distinct()
    assert clean.impute_dates(nothing, ["d"], ["id"]).where("d is not null").count() == 0


def test_standardize_constant_is_zero(frame):
    out = clean.standardize(frame({"x": [5.0, 5.0]}, "x double"), ["x"]).toPandas()
    assert out["x_scaled"].tolist() == [0, 0]


def test_one_hot(dirty):
    wide = clean.one_hot_columns(dirty, ["c"], 20).toPandas().sort_values("id")
    assert wide["c_a"].tolist() == [0, 1, 0, 0, 1, 0, 0]
    assert "c_a" not in clean.one_hot_columns(dirty, ["c"], 1).columns


def test_cleaning_summary(dirty):
    after = clean.encode(clean.drop_sparse_columns(clean.drop_duplicate_rows(dirty), 0.5), ["c"])
    facts = {(r["step"], r["subject"]): r["value"] for r in clean.cleaning_summary(dirty, after, ["c"]).collect()}
    assert facts["duplicates_removed", None] == 1 and facts["encoded_column", "c"] == 2
    assert ("dropped_column", "empty") in facts


def test_empty_table(spark):
    empty = spark.createDataFrame([], "x double, c string")
    assert quality.missing_totals(empty).first()["missing_pct"] is None
    assert quality.quality_score(empty).first()["rows"] == 0
    assert describe.numeric_describe(empty, ["x"]).first()["median"] is None
    assert clean.impute_mode(clean.impute_median(empty, ["x"]), ["c"]).count() == 0
    assert describe.histogram(empty, "x").count() == 0


def test_json_array_and_lines(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "r.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, records)))
    assert read_table(spark, str(tmp_path / "r.json")).count() == 2
    assert read_table(spark, str(tmp_path / "r.jsonl")).count() == 2
    assert read_json(spark, str(tmp_path / "r.json"), "a int").columns == ["a"]


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/tmp/table.xyz")
    with pytest.raises(ValueError):
        read_table(spark, "/tmp/table.xls")


def test_csv_extension_ignores_case(spark, tmp_path):
    (tmp_path / "T.CSV").write_text('a,b\n1,"x,""y"""\n2,z\n')
    df = read_table(spark, str(tmp_path / "T.CSV"))
    assert df.dtypes[0] == ("a", "int") and df.first()["b"] == 'x,"y"'


def test_workbooks(spark, tmp_path):
    for i in range(2):
        pdf = pd.DataFrame(
            {"n": [i, i + 1], "t": ["a<b", None], "when": [pd.Timestamp("2024-03-01 12:30"), pd.NaT], "r": [0.5, 1.5]}
        )
        (tmp_path / f"b{i}.xlsx").write_bytes(workbook_bytes(pdf))
    df = read_table(spark, str(tmp_path / "b*.xlsx"))
    assert dict(df.dtypes) == {"n": "bigint", "r": "double", "t": "string", "when": "timestamp"}
    row = df.where("n = 0").first()
    assert row["t"] == "a<b" and row["when"] == datetime(2024, 3, 1, 12, 30)


def test_workbooks_are_parsed_once(spark, tmp_path):
    """The types of the columns need all rows, but not a second look into the workbooks."""
    days = pd.to_datetime(["2024-02-29", None, "1999-12-31 23:59:59.5"], format="ISO8601")
    pdf = pd.DataFrame({"n": [1, 2, 3], "x": [0.5, None, -1e-7], "s": ["5-LOW", "a<&b", None], "d": days, "o": ["1", " 2.5e-3 ", "-Infinity"]})
    opened = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame([("b.xlsx", bytearray(workbook_bytes(pdf)))], "path string, content binary")

    def count(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    rows = workbooks.parse_workbooks(files.mapInArrow(count, files.schema))
    assert [f.dataType.simpleString() for f in rows.schema] == ["timestamp", "bigint", "double", "string", "double"] and rows.columns == list("dnosx")
    found = rows.orderBy("n").collect()
    assert [r["x"] for r in found] == [0.5, None, -1e-7] and [r["s"] for r in found] == ["5-LOW", "a<&b", None]
    assert [r["o"] for r in found] == [1.0, 0.0025, -math.inf] and [str(r["d"]) for r in found] == ["2024-02-29 00:00:00", "None", "1999-12-31 23:59:59.500000"]
    assert opened.value == 1


def test_texts_that_cast_to_double_pass_the_first_look(spark):
    texts = ["1", "-1.5", ".5", "1.", "1e5", "1E-5", "1.5e+7d", "2f", " 3 ", "NaN", "nan", "Infinity", "-inf", "+Infinity", "0x1.8p-3", "\t4\n"]
    df = spark.createDataFrame([(t,) for t in [*texts, "5-LOW", "1998-02-06 00:00:00", "a b", ""]], "t string")
    kept = df.select(F.col("t").try_cast("double").isNotNull().alias("casts"), F.col("t").rlike(workbooks._MAY_BE_NUMBER).alias("looks")).collect()
    assert sum(r["casts"] for r in kept) >= 12 and all(r["looks"] for r in kept if r["casts"])
    assert not any(r["looks"] for r in kept[-4:])


def test_workbook_shared_strings_and_flags():
    book = workbook_bytes(pd.DataFrame({"a": [1]}))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if "sheet1" not in name:
                new.writestr(name, old.read(name))
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>k</t></si><si><r><t>v</t></r><r><t>w</t></r></si></sst>')
        new.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>f</t></is></c></row>'
            '<row><c r="C2" t="b"><v>1</v></c><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>',
        )
    assert list(workbook_rows(out.getvalue())) == [{"f": "true", "k": "vw"}]


def test_folder_watch_two_drops(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    args = (spark, str(folder), "a int, b string", str(tmp_path / "out"), str(tmp_path / "state"))
    (folder / "one.csv").write_text("a,b\n1,x\n3,\n")
    watch_folder(*args).awaitTermination()
    (folder / "two.csv").write_text("a,b\n5,y\n")
    watch_folder(*args).awaitTermination()
    watch_folder(*args).awaitTermination()  # nothing new
    got = spark.read.parquet(str(tmp_path / "out"))
    facts = {(r["file"][-7:], r["column"]): (r["rows"], r["missing"], r["mean"]) for r in got.collect()}
    assert facts == {
        ("one.csv", "a"): (2, 0, 2.0),
        ("one.csv", "b"): (2, 1, None),
        ("two.csv", "a"): (1, 0, 5.0),
        ("two.csv", "b"): (1, 0, None),
    }
    assert got.select("batch").distinct().count() == 2


def test_poll_sees_changed_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    args = (spark, str(folder), "a int", str(tmp_path / "out"), str(tmp_path / "state"))
    (folder / "one.csv").write_text("a\n1\n")
    (folder / "two.csv").write_text("a\n5\n")
    assert poll_folder(*args).count() == 2 and poll_folder(*args).count() == 0
    (folder / "one.csv").write_text("a\n1\n3\n")
    later = os.stat(folder / "one.csv").st_mtime + 10
    os.utime(folder / "one.csv", (later, later))
    assert [r["path"][-7:] for r in poll_folder(*args).collect()] == ["one.csv"]
    rows = sorted((r["file"][-7:], r["rows"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("one.csv", 1), ("one.csv", 2), ("two.csv", 1)]


@pytest.mark.parametrize(
    "values, role, first",
    [
        (["01/02/2024", "12/31/2024"], "datetime", "2024-01-02 00:00:00"),
        (["01/02/2024", "31/12/2024"], "datetime", "2024-02-01 00:00:00"),
        (["2024/01/05 10:30", None], "datetime", "2024-01-05 10:30:00"),
        (["Jan 5, 2024", " Feb 6, 2024 "], "datetime", "2024-01-05 00:00:00"),
        (["January 5, 2024 9:05 PM"], "datetime", "2024-01-05 21:05:00"),
        (["5 March 2024", "6 May 2024"], "datetime", "2024-03-05 00:00:00"),
        (["5-Mar-2024"], "datetime", "2024-03-05 00:00:00"),
        (["20240105", "20241231"], "datetime", "2024-01-05 00:00:00"),
        (["20240105", "20241331"], "categorical", None),
        (["31.12.2024"], "datetime", "2024-12-31 00:00:00"),
        (["2024-01-05T10:30:00"], "datetime", "2024-01-05 10:30:00"),
        (["2024", "2023"], "categorical", None),
        (["12345", "20240"], "categorical", None),
        (["01/02/2024", "2024/01/02"], "categorical", None),
        (["01/02/2024", "soon"], "categorical", None),
        (["", " "], "categorical", None),
        ([None], "categorical", None),
    ],
)
def test_dates_in_text(frame, values, role, first):
    df = frame({"a b": values}, "`a b` string")
    roles = schema.classify(df)
    assert schema.column_roles(df).first()["role"] == role == ("datetime" if roles.datetime else "categorical")
    if first:
        assert str(schema.apply_roles(df, roles).first()[0]) == first
