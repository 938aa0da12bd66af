"""Wide tables to long ones and one-row results to one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.scalars import (
    field_type,
    is_moment,
    literal,
    number_sql,
    quoted,
    reject_maps,
    short_sql,
)


def per_column(df: DataFrame, parts: Sequence[dict[str, str]]) -> DataFrame:
    """One aggregation over the table, handed out as one row per entry of ``parts``.

    Every entry maps the same names to SQL aggregates or constants. All of them are computed in a
    single pass, and the one aggregated row is unfolded afterwards.
    """
    rows = ", ".join(
        "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in part.items()) + ")" for part in parts
    )
    return df.selectExpr("count(*) AS _all", f"array({rows}) AS _rows").selectExpr("inline(_rows)")


def literal_rows(spark: SparkSession, rows: Sequence[dict[str, object]]) -> DataFrame:
    """A handful of known rows, such as one per column of a schema."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def long_numbers(df: DataFrame, columns: Sequence[str], *, strip: bool = False) -> DataFrame:
    """``(column, value)``: one row per finite number. Expands rows in place, without a shuffle."""
    if not columns:
        raise ValueError("no numeric column to work on")
    numbers = df.selectExpr(*[f"{number_sql(df, c, strip=strip)} AS {quoted(c)}" for c in columns])
    return _melt(numbers, columns).filter("value IS NOT NULL")


def long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` with every value as text, missing ones included."""
    return _melt(df.selectExpr(*[f"{text_sql(df, c)} AS {quoted(c)}" for c in columns]), columns)


def _melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    safe = {f"c{i}": name for i, name in enumerate(columns)}
    if all("." not in name and "`" not in name for name in columns):
        return df.unpivot([], list(columns), "column", "value")
    names = F.create_map(*[F.lit(x) for pair in safe.items() for x in pair])
    melted = df.toDF(*safe).unpivot([], list(safe), "column", "value")
    return melted.select(names[F.col("column")].alias("column"), "value")


def text_sql(df: DataFrame, name: str) -> str:
    """A value as text: equal values give equal texts, different ones different texts."""
    dtype = field_type(df, name)
    column = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"CAST(nanvl({column}, NULL) + CAST(0 AS {dtype.simpleString()}) AS STRING)"
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return f"to_json({column})"
    reject_maps(df, [name])
    return column if isinstance(dtype, T.StringType) else f"CAST({column} AS STRING)"


def as_text(df: DataFrame, name: str) -> Column:
    return F.expr(text_sql(df, name))


def digest_sql(values: list[str]) -> list[str]:
    """Two 64-bit hashes of values with different beginnings, together 128 bits; missing values count."""
    # A hash runs on through its arguments and passes over missing ones, so gaps are told first.
    gaps = f"concat({', '.join(f'int(isnull({v}))' for v in values)})"
    return [f"xxhash64('{begin}', {gaps}, {', '.join(values)})" for begin in ("first", "second")]


SLOTS = {"whole": "BIGINT", "number": "DOUBLE", "moment": "TIMESTAMP", "text": "STRING"}


def slot_of(dtype: T.DataType) -> str:
    """The typed slot that keeps a value's own ordering."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "whole"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "number"
    if is_moment(dtype):
        return "moment"
    return "text"


def long_typed(df: DataFrame, columns: Sequence[str], *, short: bool = False) -> dict[str, DataFrame]:
    """``(column, value)`` of every present value, one table per slot, so that types stay apart.

    The tables read different columns, so together they read the data once. ``short`` puts digests
    in place of long texts.
    """
    by_slot: dict[str, list[str]] = {}
    for name in columns:
        by_slot.setdefault(slot_of(field_type(df, name)), []).append(name)
    out = {}
    for slot, names in by_slot.items():
        values = [slot_sql(df, c, slot) for c in names]
        if short and slot == "text":
            values = [short_sql(v) for v in values]
        typed = df.selectExpr(*[f"{v} AS {quoted(c)}" for c, v in zip(names, values, strict=True)])
        out[slot] = _melt(typed, names).filter("value IS NOT NULL")
    return out


def slot_sql(df: DataFrame, name: str, slot: str) -> str:
    if slot == "text":
        return text_sql(df, name)
    if slot == "number":
        return f"nanvl(CAST({quoted(name)} AS DOUBLE), NULL) + 0D"
    return f"CAST({quoted(name)} AS {SLOTS[slot]})"
