"""What the columns of a table hold, judged by their content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import fixed
from tabscope.functions.reshape import literal_rows, per_column
from tabscope.functions.scalars import (
    Names,
    key_sql,
    literal,
    moment_sql,
    quoted,
    ref,
    string_columns,
    strip_numeric,
    trim_headers,
)


def _role(df: DataFrame, name: str, order_by: Names) -> str:
    """Numeric by type, or text with a digit somewhere and no letter in the first row."""
    dtype = df.schema[name].dataType
    if not isinstance(dtype, T.StringType):
        nested = isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))
        return literal("object" if nested else "numeric")
    text = quoted(name)
    digits = f"coalesce(bool_or({text} RLIKE '[0-9]'), false)"
    # A missing first value reads "None".
    lettered = f"coalesce(min_by({text}, {key_sql(order_by)}) RLIKE '[A-Za-z]', true)"
    return f"IF({digits} AND NOT {lettered}, 'numeric', 'object')"


def column_roles(df: DataFrame, order_by: Names) -> DataFrame:
    """``(position, column, role)`` with role ``numeric`` or ``object``, in one pass."""
    parts = [
        {"position": str(i), "column": literal(c), "role": _role(df, c, order_by)}
        for i, c in enumerate(df.columns)
    ]
    return per_column(df, parts)


def role_counts(df: DataFrame, order_by: Names) -> DataFrame:
    """``(count_header, count_records, all_columns, numeric_columns, object_columns)``, one row."""
    roles = [f"named_struct('column', {literal(c)}, 'role', {_role(df, c, order_by)})" for c in df.columns]
    summary = df.selectExpr("count(*) AS count_records", f"array({', '.join(roles)}) AS roles")
    return summary.select(
        F.lit(len(df.columns)).alias("count_header"),
        "count_records",
        F.array(*[F.lit(c) for c in df.columns]).alias("all_columns"),
        _named("numeric").alias("numeric_columns"),
        _named("object").alias("object_columns"),
    )


def _named(role: str) -> Column:
    return F.transform(F.filter("roles", lambda r: r["role"] == role), lambda r: r["column"])


def header_summary(df: DataFrame, order_by: Names) -> DataFrame:
    """One row: counts, all columns and those that are numeric, text or dates.

    Only text columns are looked at for dates; columns with a numeric role have been turned into
    numbers by the time the headers are read.
    """
    texts = string_columns(df)
    roles = []
    for c in df.columns:
        dated = f"{_date_format(c)} IS NOT NULL" if c in texts else "false"
        role = _role(df, c, order_by)
        roles.append(f"named_struct('column', {literal(c)}, 'role', {role}, 'dated', {dated})")
    summary = df.selectExpr("count(*) AS count_records", f"array({', '.join(roles)}) AS roles")
    dated = F.filter("roles", lambda r: (r["role"] == "object") & r["dated"])
    labels = F.transform(
        _named("numeric"), lambda c: F.struct(c.alias("value"), c.alias("label"))
    )
    return summary.select(
        F.lit(len(df.columns)).alias("count_header"),
        "count_records",
        labels.alias("header_label"),
        F.array(*[F.lit(c) for c in df.columns]).alias("header"),
        _named("numeric").alias("header_numeric"),
        _named("object").alias("object_columns"),
        F.transform(dated, lambda r: r["column"]).alias("header_date"),
    )


def typed_by_role(df: DataFrame, order_by: Names) -> DataFrame:
    """Trimmed headers, and text columns with a numeric role reduced to numbers.

    The roles decide the schema, so they are looked up right away: one pass, one small row.
    """
    roles = column_roles(df, order_by).filter("role = 'numeric'").collect()  # at most one row per column
    numeric = {r["column"] for r in roles} & set(string_columns(df))
    if numeric:
        df = df.select(*[strip_numeric(ref(c)).alias(c) if c in numeric else ref(c) for c in df.columns])
    return trim_headers(df)


# --- dates ----------------------------------------------------------------------------------


ALL_DATE_FORMATS = (*fixed.DATE_FORMATS, *fixed.FREE_DATE_FORMATS)
# Rows that rule out most formats before the whole table is read.
FIRST_LOOK = 100


def _fits(name: str, pattern: str, shape: str) -> str:
    return f"count({moment_sql(name, pattern, shape)}) = count({quoted(name)})"


def _date_format(name: str) -> str:
    """First format that reads every present value of a text column, NULL if none does.

    The fixed formats come first, so they decide ambiguous columns; a column without any value
    passes with the first one.
    """
    return f"CASE {' '.join(f"WHEN {_fits(name, *f)} THEN '{f[0]}'" for f in ALL_DATE_FORMATS)} END"


def date_columns(df: DataFrame) -> DataFrame:
    """``(column, date_format)`` for text columns whose every value is a date, in one pass."""
    texts = string_columns(df)
    if not texts:
        empty = literal_rows(df.sparkSession, [{"column": "", "date_format": ""}])
        return empty.filter(F.lit(False))
    parts = [{"column": literal(c), "date_format": _date_format(c)} for c in texts]
    return per_column(df, parts).filter("date_format IS NOT NULL")


def date_formats(df: DataFrame) -> dict[str, str]:
    """The same as a dictionary; it decides a schema, so it is looked up right away.

    A format has to read every value, so those that fail on a few rows need no second look: tables
    without dates are not read as a whole.
    """
    texts = string_columns(df)
    if not texts:
        return {}
    left = _fitting(df.select(*[ref(c) for c in texts]).limit(FIRST_LOOK), {c: ALL_DATE_FORMATS for c in texts})
    left = _fitting(df, left) if left else left
    return {c: formats[0][0] for c, formats in left.items()}


def _fitting(df: DataFrame, wanted: dict[str, Sequence[tuple[str, str]]]) -> dict[str, Sequence[tuple[str, str]]]:
    """The formats of each column that read all of its values."""
    parts = [
        {"column": literal(c), "fits": f"array({', '.join(_fits(c, *f) for f in formats)})"}
        for c, formats in wanted.items()
    ]
    rows = per_column(df, parts).collect()  # one row per text column
    kept = {r["column"]: [f for f, fits in zip(wanted[r["column"]], r["fits"], strict=True) if fits] for r in rows}
    return {c: formats for c, formats in kept.items() if formats}


def is_date_column(df: DataFrame, name: str) -> bool:
    """Whether one column holds dates, by its type or by every one of its values."""
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    return isinstance(df.schema[name].dataType, T.StringType) and name in date_formats(df.select(ref(name)))


def parse_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Text columns turned into timestamps by their known formats."""
    shapes = dict(ALL_DATE_FORMATS)
    return df.selectExpr(
        *[
            f"{moment_sql(c, formats[c], shapes[formats[c]])} AS {quoted(c)}" if c in formats else quoted(c)
            for c in df.columns
        ]
    )


def dataset_summary(df: DataFrame, file_type: str | None = None, file_size: int | None = None) -> DataFrame:
    """``(total_rows, total_columns, file_type, file_size)``, one row."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        F.lit(file_type).cast("string").alias("file_type"),
        F.lit(file_size).cast("bigint").alias("file_size"),
    )
