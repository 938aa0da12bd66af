"""Whole requests: several operators put together into one plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tabscope.functions.scalars import Names
from tabscope.operators.cleanse import cleanse
from tabscope.operators.columns import column_analysis, type_mix
from tabscope.operators.kpi import kpi_cards
from tabscope.operators.paging import page_info, page_slice
from tabscope.operators.profile import profile_documents
from tabscope.operators.roles import dataset_summary, header_summary, typed_by_role
from tabscope.operators.series import chart
from tabscope.sources.readers import read_csv_for_profile
from tabscope.sources.writers import append_profile, write_cleansed


def chart_of(
    df: DataFrame,
    name: str,
    x: str,
    y: str | None = None,
    *,
    order_by: Names,
    countries: DataFrame | None = None,
) -> DataFrame:
    """A chart over a raw table: text columns that hold numbers are turned into numbers first."""
    return chart(typed_by_role(df, order_by), name, x, y, order_by=order_by, countries=countries)


def cards_of(df: DataFrame, type_field: str, aggregation: str, fields: Names, *, order_by: Names) -> DataFrame:
    """KPI cards over a raw table."""
    return kpi_cards(typed_by_role(df, order_by), type_field, aggregation, fields, order_by)


def headers_of(df: DataFrame, order_by: Names) -> DataFrame:
    return header_summary(df, order_by)


def details_of(
    df: DataFrame, order_by: Names, page: int = 1, size: int = 100, *, file_type: str | None = None
) -> dict[str, DataFrame]:
    """What a file's detail page shows, each part as its own lazy table."""
    return {
        "rows": page_slice(df, order_by, page, size),
        "paging": page_info(df, page, size),
        "column_analysis": column_analysis(df, order_by),
        "data_types": type_mix(df),
        "dataset_summary": dataset_summary(df, file_type),
    }


def cleanse_and_profile(
    df: DataFrame,
    target: str,
    store: str,
    *,
    file_id: str,
    project_id: str,
    steps: Iterable[str] = ("delete_missing_row", "delete_duplicate_row"),
) -> int:
    """Cleanses a table into a CSV file, then profiles that file and stores the documents.

    Returns the number of rows written.
    """
    rows = write_cleansed(cleanse(df, steps), target)
    spark: SparkSession = df.sparkSession
    append_profile(profile_documents(read_csv_for_profile(spark, target)), file_id, project_id, store)
    return rows
