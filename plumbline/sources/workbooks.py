"""Spreadsheet workbooks (.xlsx) as a Spark source: one task parses one workbook of many.

Only the first sheet is read and its first row is the header, as spreadsheets hold at most about a
million rows. Values arrive as text and are typed by one aggregate over all rows, or by a schema.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import chain, islice
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.scratch import scratch_path

# XML namespaces and built-in date formats of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_C, _V, _T, _ROW = (f"{_MAIN}{name}" for name in ("c", "v", "t", "row"))
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = datetime(1899, 12, 30)

# Lets every text through that casts to double, and few others: a cast that fails costs an exception, a hundred times as much.
_MAY_BE_NUMBER = r"^[\x00-\x20]*[-+]?[0-9.a-zA-Z]+([-+][0-9]+)?[dDfF]?[\x00-\x20]*$"

_CELLS = "cells map<string,string>"
_BATCH_ROWS = 10_000


def _text(node) -> str:
    return "".join([t.text or "" for t in node.iter(_T)])


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", ""))
        for f in root.iter(f"{_MAIN}numFmt")
    }
    dated = _DATE_FORMATS | {i for i, code in custom.items() if re.search("[dyhs]", code.lower())}
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", 0)) in dated}


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == sheet.get(f"{_REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


@lru_cache(maxsize=1 << 16)
def _stamp(serial: str) -> str:
    return (_EPOCH + timedelta(microseconds=round(float(serial) * 86_400_000) * 1000)).isoformat(sep=" ")


def _cell_value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    raw = cell.findtext(_V)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return _stamp(raw)
    return raw


def workbook_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of the first sheet as ``{header: value}``; empty cells are absent."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    dates = _date_styles(book)
    header: dict[str, str] | None = None
    column_of: dict[str, str | None] = {}  # of a cell's reference without its row number; None where it has no letters
    with book.open(_first_sheet(book)) as sheet:
        for _, node in ElementTree.iterparse(sheet):
            if node.tag != _ROW:
                continue
            values = {}
            for position, cell in enumerate(node.findall(_C)):
                place = (cell.get("r") or "").rstrip("0123456789")
                if place not in column_of:
                    letters = re.match("[A-Z]+", place)
                    column_of[place] = letters.group() if letters else None
                values[column_of[place] or str(position)] = _cell_value(cell, shared, dates)
            node.clear()
            if header is None:
                header = {c: v for c, v in values.items() if v is not None}
            else:
                yield {header[c]: v for c, v in values.items() if c in header and v is not None}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = workbook_rows(content.as_py())
            while held := list(islice(rows, _BATCH_ROWS)):
                ends = np.cumsum([0, *map(len, held)])
                names = pa.array(chain.from_iterable(held), pa.string())
                values = pa.array(chain.from_iterable(cells.values() for cells in held), pa.string())
                yield pa.RecordBatch.from_arrays([pa.MapArray.from_arrays(pa.array(ends, pa.int32()), names, values)], names=["cells"])


def parse_workbooks(files: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """Parse ``(path, content)`` rows into one table with the columns of all headers."""
    rows = files.select("content").mapInArrow(_parse, _CELLS)
    if schema is not None:
        fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
        return rows.select(*[F.try_element_at("cells", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in fields])
    # The types are known after all rows, so the cells are written: no workbook is parsed twice.
    path = scratch_path(rows.sparkSession, "cells")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    # At most one entry per spreadsheet column comes back to the driver.
    value = F.col("value")
    facts = (
        rows.select(F.explode("cells").alias("name", "value"))
        .groupBy("name")
        .agg(
            F.count(value).alias("n"),
            F.count(value.try_cast("bigint")).alias("whole"),
            F.count(F.when(value.rlike(_MAY_BE_NUMBER), value.try_cast("double"))).alias("number"),
            F.count(F.when(value.isin("true", "false"), 1)).alias("flag"),
            F.count(F.when(value.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(value))).alias("stamp"),
        )
        .orderBy("name")
        .collect()
    )

    def kind(f) -> str:
        for column, dtype in (("whole", "bigint"), ("number", "double"), ("flag", "boolean"), ("stamp", "timestamp")):
            if f["n"] and f[column] == f["n"]:
                return dtype
        return "string"

    return rows.select(
        *[F.try_element_at("cells", F.lit(f["name"])).try_cast(kind(f)).alias(f["name"]) for f in facts]
    )


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read one workbook, a folder or a glob of workbooks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return parse_workbooks(files, schema)
