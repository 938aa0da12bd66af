"""Per-column facts for a file's detail page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions import fixed
from tabscope.functions.reshape import per_column, text_sql
from tabscope.functions.scalars import FLOAT_TEXT, Names, as_list, key_sql, literal, order_columns
from tabscope.operators.profile import distinct_per_column


def column_analysis(df: DataFrame, order_by: Names) -> DataFrame:
    """``(position, column, total_values, unique_values, unique_percentage, sample_values, is_nullable)``.

    A missing cell counts as one more value. The sample holds the first five values in row order.
    """
    columns = df.columns
    if any(name.startswith("-") for name in as_list(order_by)):
        raise ValueError("the sample follows ascending keys")
    parts = []
    for i, c in enumerate(columns):
        text = text_sql(df, c)
        parts.append(
            {
                "position": str(i),
                "column": literal(c),
                "total_values": "count(*)",
                "gaps": f"count_if({text} IS NULL)",
                "is_nullable": f"coalesce(bool_or(coalesce({text}, '') = ''), false)",
            }
        )
    unique = distinct_per_column(df, columns)
    # Five rows, turned into one list per column.
    first = df.orderBy(*order_columns(order_by)).limit(fixed.SAMPLE_VALUES)
    entry = "sort_array(collect_list(named_struct('at', {0}, 'value', {1})))"
    lists = [
        {"column": literal(c), "sample": entry.format(key_sql(order_by), text_sql(df, c))} for c in columns
    ]
    samples = per_column(first, lists).selectExpr("column", "sample.value AS sample_values")
    facts = per_column(df, parts).join(F.broadcast(unique), "column").join(F.broadcast(samples), "column")
    count = F.col("unique_value_count") + F.when(F.col("gaps") > 0, 1).otherwise(0)
    share = F.round(F.try_divide(count * 100.0, F.col("total_values")), 2)
    return facts.select(
        "position",
        "column",
        "total_values",
        count.alias("unique_values"),
        F.coalesce(share, F.lit(0.0)).alias("unique_percentage"),
        "sample_values",
        "is_nullable",
    )


def type_mix(df: DataFrame) -> DataFrame:
    """``(column, numeric, boolean, date, string)``: percent of values that read as each type.

    Numbers go first, then truth values, then dates; a missing cell reads as text.
    """
    shapes = "|".join(shape.strip("^$") for shape in fixed.DATE_SHAPES)
    truths = ", ".join(literal(t) for t in fixed.TRUTH_TEXTS)
    parts = []
    for name in df.columns:
        text = f"coalesce({text_sql(df, name)}, 'None')"
        kind = (
            f"CASE WHEN {text} RLIKE r'{FLOAT_TEXT}' THEN 'numeric' WHEN lower({text}) IN ({truths}) THEN 'boolean' "
            f"WHEN {text} RLIKE r'^({shapes})$' THEN 'date' ELSE 'string' END"
        )
        share = "coalesce(round(try_divide(count_if({0} = '{1}') * 100D, count(*)), 2), 0D)"
        kinds = ("numeric", "boolean", "date", "string")
        parts.append({"column": literal(name), **{k: share.format(kind, k) for k in kinds}})
    return per_column(df, parts)
