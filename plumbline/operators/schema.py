"""Column roles, types, parsing, projections and distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _static_role(data_type: T.DataType) -> str | None:
    """Role known from the type alone; text needs a look at the data."""
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(data_type, _DATE_TYPES):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return None
    return "other"


@dataclass(frozen=True)
class RoleMap:
    """Column names by role, in schema order; ``forms`` names the form of the text columns that hold dates."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    datetime: tuple[str, ...]
    other: tuple[str, ...]
    forms: Mapping[str, str] = field(default_factory=dict)


def one_row_to_long(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return row.select(F.inline(F.array(*structs)))


# Forms of dates in text, first fit first: what the text must look like, and the pattern that reads it.
# A date may be followed by a time. Numbers of other lengths than a packed date's are codes.
_TIME = r"( \d{1,2}:\d{2}(:\d{2})?( [AP]M)?)?$"
_CLOCK = "[ h:mm:ss a][ h:mm a][ H:mm:ss][ H:mm]"
_NAMED, _FULL = "[A-Za-z]{3}", "[A-Za-z]{3,9}"
DATE_FORMS: dict[str, tuple[str, str | None]] = {
    "iso": (r"^\d{4}-\d{1,2}(-|$)", None),
    "year/month/day": (r"^\d{4}/\d{1,2}/\d{1,2}" + _TIME, "yyyy/M/d" + _CLOCK),
    "month/day/year": (r"^\d{1,2}/\d{1,2}/\d{4}" + _TIME, "M/d/yyyy" + _CLOCK),
    "day/month/year": (r"^\d{1,2}/\d{1,2}/\d{4}" + _TIME, "d/M/yyyy" + _CLOCK),
    "month-day-year": (r"^\d{1,2}-\d{1,2}-\d{4}" + _TIME, "M-d-yyyy" + _CLOCK),
    "day-month-year": (r"^\d{1,2}-\d{1,2}-\d{4}" + _TIME, "d-M-yyyy" + _CLOCK),
    "month.day.year": (r"^\d{1,2}\.\d{1,2}\.\d{4}" + _TIME, "M.d.yyyy" + _CLOCK),
    "day.month.year": (r"^\d{1,2}\.\d{1,2}\.\d{4}" + _TIME, "d.M.yyyy" + _CLOCK),
    "short name day, year": (rf"^{_NAMED} \d{{1,2}}, \d{{4}}" + _TIME, "MMM d, yyyy" + _CLOCK),
    "name day, year": (rf"^{_FULL} \d{{1,2}}, \d{{4}}" + _TIME, "MMMM d, yyyy" + _CLOCK),
    "day short name year": (rf"^\d{{1,2}}[ -]{_NAMED}[ -]\d{{4}}" + _TIME, "d[ ][-]MMM[ ][-]yyyy" + _CLOCK),
    "day name year": (rf"^\d{{1,2}} {_FULL} \d{{4}}" + _TIME, "d MMMM yyyy" + _CLOCK),
    "packed": (r"^\d{8}$", "yyyyMMdd"),
}


def text_as_timestamp(column: Column, form: str = "iso") -> Column:
    """The timestamp that a text stands for; NULL unless it looks like the form and parses as one."""
    looks, pattern = DATE_FORMS[form]
    text = F.trim(column)
    parsed = F.try_to_timestamp(text) if pattern is None else F.try_to_timestamp(text, F.lit(pattern))
    return F.when(text.rlike(looks), parsed)


def _roles(df: DataFrame) -> DataFrame:
    """``(column, dtype, role, form)``, all rows checked in one aggregate."""
    text = [f.name for f in df.schema.fields if _static_role(f.dataType) is None]

    def counts(c: str) -> Column:
        column = F.col(f"`{c}`")
        return F.struct(F.count(column).alias("n"), *[F.count(text_as_timestamp(column, form)).alias(form) for form in DATE_FORMS])

    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[counts(c).alias(f"t{i}") for i, c in enumerate(text)])
    structs = []
    for field_ in df.schema.fields:
        role = _static_role(field_.dataType)
        form = F.lit(None).cast("string")
        role_value = F.lit(role)
        if role is None:
            check = F.col(f"t{text.index(field_.name)}")
            fits = [F.when((check["n"] > 0) & (check["n"] == check[name]), F.lit(name)) for name in DATE_FORMS]
            form = F.coalesce(*fits)
            role_value = F.when(form.isNotNull(), "datetime").otherwise("categorical")
        structs.append(
            F.struct(
                F.lit(field_.name).alias("column"),
                F.lit(field_.dataType.simpleString()).alias("dtype"),
                role_value.alias("role"),
                form.alias("form"),
            )
        )
    return one_row_to_long(row, structs)


def column_roles(df: DataFrame) -> DataFrame:
    """``(column, dtype, role)``; a text column is a date when it has values and one form reads all of them.

    Where month and day may be either way round in all rows, the month comes first.
    """
    return _roles(df).drop("form")


def classify(df: DataFrame, parse_text: bool = True) -> RoleMap:
    """Roles as names on the driver (one small row per column)."""
    known, forms = {f.name: _static_role(f.dataType) for f in df.schema.fields}, {}
    if parse_text and any(role is None for role in known.values()):
        found = _roles(df).collect()
        known = {r["column"]: r["role"] for r in found}
        forms = {r["column"]: r["form"] for r in found if r["form"]}
    roles = {name: role or "categorical" for name, role in known.items()}
    pick = lambda wanted: tuple(c for c in df.columns if roles[c] == wanted)
    return RoleMap(pick("numeric"), pick("categorical"), pick("datetime"), pick("other"), forms)


def apply_roles(df: DataFrame, roles: RoleMap) -> DataFrame:
    """Parse text columns in the datetime role; NaN becomes NULL in floating columns."""
    changes: dict[str, Column] = {}
    for field_ in df.schema.fields:
        column = F.col(f"`{field_.name}`")
        if field_.name in roles.datetime and isinstance(field_.dataType, T.StringType):
            changes[field_.name] = text_as_timestamp(column, roles.forms.get(field_.name, "iso"))
        elif isinstance(field_.dataType, (T.FloatType, T.DoubleType)):
            changes[field_.name] = F.when(~F.isnan(column), column)
    return df.withColumns(changes) if changes else df


def dtype_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, non_null, same_dtype_columns)`` in one scan."""
    dtypes = dict(df.dtypes)
    row = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)])
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(dtypes[c]).alias("dtype"),
            F.col(f"n{i}").alias("non_null"),
            F.lit(sum(t == dtypes[c] for t in dtypes.values())).cast("long").alias("same_dtype_columns"),
        )
        for i, c in enumerate(df.columns)
    ]
    return one_row_to_long(row, structs)


def parse_timestamps(df: DataFrame, column: str, into: str, fmt: str | None = None, strict: bool = False) -> DataFrame:
    """Parse text to timestamp; text that does not parse becomes NULL unless ``strict``."""
    args = (F.col(column),) if fmt is None else (F.col(column), F.lit(fmt))
    parser = F.to_timestamp(F.col(column), fmt) if strict else F.try_to_timestamp(*args)
    return df.withColumn(into, parser)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns of the rows where all of them are known."""
    return df.select(*columns).na.drop()


def rows_where_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter (pushed to the scan)."""
    return df.where(F.col(column) == F.lit(value))


def value_row_counts(df: DataFrame, column: str) -> DataFrame:
    """Row count of every value's equality filter, as one aggregation instead of one filter each."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def derive_columns(df: DataFrame, new: Mapping[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """Add derived columns, side by side with the present ones, and drop others."""
    return df.withColumns(dict(new)).drop(*drop)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def as_text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` with every non-null value as text."""
    return df.select(*[as_text(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "value").where(
        F.col("value").isNotNull()
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for several columns in one aggregation (map-side combined)."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column, distinct_values)``, nulls not counted."""
    if approx:
        row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)])
        structs = [
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("distinct_values")) for i, c in enumerate(columns)
        ]
        return one_row_to_long(row, structs)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    counted = value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("distinct_values"))
