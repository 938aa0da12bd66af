"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import fixed
from tabscope.functions.free_dates import free_date_sql

NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DIGITS = r"\d(_?\d)*"
FLOAT_TEXT = (
    rf"(?i)^\s*[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)\s*$"
)

Names = str | Sequence[str]


def ref(name: str) -> Column:
    """Column of that exact name, dots included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """The same in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str | None) -> str:
    """A text constant in SQL."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_list(names: Names | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def field_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"the table has no column {name}")
    return df.schema[name].dataType


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_number(df: DataFrame, name: str) -> bool:
    """Whether the column's own type is numeric; truth values count as numbers."""
    return isinstance(field_type(df, name), (T.NumericType, T.BooleanType))


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def measure_columns(df: DataFrame) -> list[str]:
    """Numeric columns without truth values."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def reject_maps(df: DataFrame, names: Iterable[str]) -> None:
    """Maps have no equality, so operators that compare values cannot take them."""
    bad = [n for n in names if "map<" in field_type(df, n).simpleString()]
    if bad:
        raise ValueError(f"Columns of map type cannot be compared: {', '.join(bad)}")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def order_columns(order_by: Names, *, descending: bool = False) -> list[Column]:
    """Sort columns; a leading minus turns one column around."""
    names = as_list(order_by)
    if not names:
        raise ValueError("order_by must name at least one column")
    out = []
    for name in names:
        turned = name.startswith("-")
        column = ref(name[1:] if turned else name)
        out.append(column.desc() if turned != descending else column.asc())
    return out


def key_sql(order_by: Names) -> str:
    """One comparable value that sorts like the columns do, in SQL text."""
    names = as_list(order_by)
    if not names:
        raise ValueError("order_by must name at least one column")
    return quoted(names[0]) if len(names) == 1 else f"struct({', '.join(quoted(n) for n in names)})"


def order_key(order_by: Names) -> Column:
    return F.expr(key_sql(order_by))


# --- missing values -------------------------------------------------------------------------


def finite(column: Column) -> Column:
    """NaN and infinities become NULL (NaN sorts above infinity, so one comparison finds both)."""
    return F.when(F.abs(column) < F.lit(math.inf), column)


def known_sql(df: DataFrame, name: str) -> str:
    """The column with NaN as NULL."""
    column = quoted(name)
    return f"nanvl({column}, NULL)" if is_floating(field_type(df, name)) else column


def known(df: DataFrame, name: str) -> Column:
    return F.expr(known_sql(df, name))


def _clean(column: Column, dtype: T.DataType) -> Column:
    if is_floating(dtype):
        return finite(column)
    if isinstance(dtype, T.ArrayType) and _has_floats(dtype):
        return F.transform(column, lambda item: _clean(item, dtype.elementType))
    if isinstance(dtype, T.StructType) and _has_floats(dtype):
        rebuilt = F.struct(*[_clean(column[f.name], f.dataType).alias(f.name) for f in dtype])
        return F.when(column.isNotNull(), rebuilt)
    if isinstance(dtype, T.MapType) and _has_floats(dtype):
        return F.transform_values(column, lambda _, item: _clean(item, dtype.valueType))
    return column


def _has_floats(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_floats(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_floats(f.dataType) for f in dtype)
    if isinstance(dtype, T.MapType):
        return _has_floats(dtype.valueType)
    return is_floating(dtype)


def nullify(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    return df.select(*[known(df, n).alias(n) for n in df.columns])


def sanitize_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, inside arrays, structs and maps as well."""
    return df.select(*[_clean(ref(f.name), f.dataType).alias(f.name) for f in df.schema])


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


# --- numbers --------------------------------------------------------------------------------


def strip_numeric(column: Column, *, keep_sign: bool = False) -> Column:
    """Text reduced to its digits and dots, as a number; NULL where nothing readable is left."""
    kept = F.regexp_replace(column.cast("string"), r"[^0-9.\-]" if keep_sign else r"[^0-9.]", "")
    return finite(kept.try_cast("double"))


def coerce_numeric(column: Column) -> Column:
    """Text as a number, NULL where it is not one. Casts also read ``12d``, hence the pattern."""
    text = column.cast("string")
    return finite(F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double")))


def number_sql(df: DataFrame, name: str, *, strip: bool = False) -> str:
    """A column of any type as a finite double; typed numbers keep their sign and exponent."""
    dtype = field_type(df, name)
    column = quoted(name)
    if isinstance(dtype, (T.NumericType, T.BooleanType)) and not is_floating(dtype):
        return f"CAST({column} AS DOUBLE)"
    if is_floating(dtype):
        return f"IF(abs({column}) < DOUBLE('Infinity'), CAST({column} AS DOUBLE), NULL)"
    if strip:
        value = f"try_cast(regexp_replace(CAST({column} AS STRING), r'[^0-9.]', '') AS DOUBLE)"
    else:
        text = f"CAST({column} AS STRING)"
        value = f"IF({text} RLIKE r'{NUMBER_TEXT}', try_cast(trim({text}) AS DOUBLE), NULL)"
    return f"IF(abs({value}) < DOUBLE('Infinity'), {value}, NULL)"


def as_number(df: DataFrame, name: str, *, strip: bool = False) -> Column:
    return F.expr(number_sql(df, name, strip=strip))


# --- text -----------------------------------------------------------------------------------


def strip_space(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def normalize_key(column: Column) -> Column:
    return strip_space(F.lower(column.cast("string")))


def capitalize(column: Column) -> Column:
    """First letter up, the rest down."""
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 1 << 30)))


def file_extension(column: Column) -> Column:
    """Extension with its dot, lower case; empty for names that only begin with a dot."""
    return F.regexp_extract(F.lower(column), r"[^/.][^/]*?(\.[^./]*)$", 1)


def classify_extension(column: Column) -> Column:
    extension = file_extension(column)
    out = F.lit("unknown")
    for suffix, kind in fixed.FILE_KINDS.items():
        out = F.when(extension == suffix, kind).otherwise(out)
    return out


def is_date_text(column: Column) -> Column:
    text = column.cast("string")
    return any_of(text.rlike(shape) for shape in fixed.DATE_SHAPES)


#: Longer texts travel as digests.
SHORT_BYTES = 128


def short_sql(column: str) -> str:
    """Text for comparing: long ones by digest, so that a shuffle does not carry them."""
    digest = f"concat('\\u0000', octet_length({column}), ':', sha2({column}, 256))"
    return f"IF(octet_length({column}) > {SHORT_BYTES}, {digest}, {column})"


def two_decimals(column: Column) -> Column:
    return F.format_string("%.2f", column.cast("double"))


# --- dates ----------------------------------------------------------------------------------


def moment_sql(name: str, pattern: str, shape: str) -> str:
    """Text of that shape as a timestamp, else NULL; the shape test spares failing parses."""
    column = quoted(name)
    text = f"IF(octet_length({column}) BETWEEN 6 AND 60 AND {column} RLIKE r'{shape}', {column}, NULL)"
    if pattern.startswith("free"):
        return free_date_sql(text, day_first=pattern.endswith("day first"))
    return f"try_cast({text} AS TIMESTAMP)" if pattern == "iso" else f"try_to_timestamp({text}, '{pattern}')"


def iso_sql(moment: str) -> str:
    """ISO text with microseconds only where there are any, from a timestamp."""
    day = "yyyy-MM-dd\\'T\\'HH:mm:ss"
    return (
        f"IF(unix_micros({moment}) % 1000000 = 0, date_format({moment}, '{day}'), "
        f"date_format({moment}, '{day}.SSSSSS'))"
    )


def iso_text(column: Column) -> Column:
    moment = column.cast("timestamp")
    day = "yyyy-MM-dd'T'HH:mm:ss"
    whole = F.unix_micros(moment) % F.lit(1_000_000) == 0
    return F.when(whole, F.date_format(moment, day)).otherwise(F.date_format(moment, f"{day}.SSSSSS"))


def epoch_seconds(column: Column) -> Column:
    return F.unix_seconds(column.cast("timestamp"))
