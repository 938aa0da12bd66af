"""Single values for cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions import fixed
from tabscope.functions.reshape import literal_rows, long_numbers, per_column
from tabscope.functions.scalars import (
    Names,
    as_list,
    capitalize,
    field_type,
    key_sql,
    literal,
    number_sql,
    quoted,
    two_decimals,
)
from tabscope.operators.profile import distinct_per_column
from tabscope.operators.quantiles import quantile_table


def _check(aggregation: str, allowed: tuple[str, ...]) -> None:
    if aggregation not in allowed:
        raise ValueError(f"cards cannot show {aggregation}; there are {', '.join(allowed)}")


_NUMBER_SQL = {
    "sum": "coalesce(sum({0}), 0D)",
    "average": "avg({0})",
    "minimum": "min({0})",
    "maximum": "max({0})",
    "count": "CAST(count({0}) AS DOUBLE)",
    "std_deviation": "stddev_samp({0})",
    "variance": "var_samp({0})",
}
_CATEGORY_SQL = {
    "first": "min_by(CAST({0} AS STRING), {1})",
    "last": "max_by(CAST({0} AS STRING), {1})",
    "count": "CAST(count(*) AS STRING)",
}


def _card(df: DataFrame, aggregation: str) -> DataFrame:
    message = capitalize(F.concat(F.lit(f"{aggregation} of "), F.col("field")))
    return df.select(
        "field", F.lit(aggregation).alias("aggregation"), "value", "value_text", message.alias("message")
    )


def kpi_number(df: DataFrame, aggregation: str, fields: Names) -> DataFrame:
    """``(field, aggregation, value, value_text, message)``: one card per number field.

    All fields are read in one pass. Values that are not numbers are left out.
    """
    _check(aggregation, fixed.NUMBER_AGGREGATIONS)
    names = as_list(fields)
    for name in names:
        field_type(df, name)
    if aggregation == "median":
        # Fields without a number keep their card, with no value.
        listed = literal_rows(df.sparkSession, [{"field": c} for c in names])
        middle = quantile_table(df, names, {"value": 0.5}).select(F.col("column").alias("field"), "value")
        cards = listed.join(F.broadcast(middle), "field", "left")
    elif aggregation == "count_distinct":
        listed = literal_rows(df.sparkSession, [{"field": c} for c in names])
        different = long_numbers(df, names).distinct().groupBy(F.col("column").alias("field")).count()
        value = F.coalesce(F.col("count"), F.lit(0)).cast("double").alias("value")
        cards = listed.join(F.broadcast(different), "field", "left").select("field", value)
    else:
        sql = _NUMBER_SQL[aggregation]
        parts = [{"field": literal(c), "value": sql.format(number_sql(df, c))} for c in names]
        cards = per_column(df, parts)
    return _card(cards.withColumn("value_text", two_decimals(F.col("value"))), aggregation)


def kpi_category(df: DataFrame, aggregation: str, fields: Names, order_by: Names | None = None) -> DataFrame:
    """``(field, aggregation, value, value_text, message)``: one card per category field.

    ``first`` and ``last`` follow ``order_by``; ``count`` counts rows.
    """
    _check(aggregation, fixed.CATEGORY_AGGREGATIONS)
    names = as_list(fields)
    for name in names:
        field_type(df, name)
    if aggregation == "count_distinct":
        found = distinct_per_column(df, names)
        cards = found.select(F.col("column").alias("field"), F.col("unique_value_count").cast("string").alias("value"))
    else:
        at = key_sql(order_by or []) if aggregation in ("first", "last") else ""
        sql = _CATEGORY_SQL[aggregation]
        cards = per_column(df, [{"field": literal(c), "value": sql.format(quoted(c), at)} for c in names])
    return _card(cards.withColumn("value_text", F.col("value")), aggregation)


def kpi_cards(
    df: DataFrame, type_field: str, aggregation: str, fields: Names, order_by: Names | None = None
) -> DataFrame:
    """Cards for ``number`` or ``category`` fields."""
    if type_field == "number":
        return kpi_number(df, aggregation, fields)
    if type_field == "category":
        return kpi_category(df, aggregation, fields, order_by)
    raise ValueError(f"Unknown field type: {type_field}")
