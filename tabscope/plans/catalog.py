"""Every operator run over the star-schema tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions import reshape, scalars
from tabscope.functions.scalars import Names
from tabscope.operators import (
    cleanse,
    columns,
    histogram,
    kpi,
    paging,
    profile,
    quality,
    roles,
    series,
)
from tabscope.plans import requests
from tabscope.sources import html_tables, readers, shared, writers
from tabscope.streaming import running

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BIN_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]

_registered: dict[str, Query] = {}


def _query(make: Query) -> Query:
    _registered[make.__name__] = make
    return make


def _query_as(name: str) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        _registered[name] = make
        return make

    return register


def catalog() -> dict[str, Query]:
    return dict(_registered)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


# --- inputs with gaps, written the same way in SQL ------------------------------------------


def lineitem_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Line items whose zero discounts and taxes are missing."""
    return table(spark, folder, "lineitem").select(
        *LINEITEM_KEY,
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
    )


def customer_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with missing balances below zero and one missing segment."""
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
    )


def order_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with dates and numbers written in several ways."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format(day, "yyyy-MM-dd").alias("iso_day"),
        F.date_format(day, "MM/dd/yyyy").alias("us_day"),
        F.date_format(day, "dd MMM yyyy").alias("long_day"),
        F.when(kind == 0, F.lit("unknown")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("some_day"),
        F.concat(F.lit("$ "), F.col("o_custkey").cast("string"), F.lit(" net")).alias("lettered"),
        F.concat(F.lit("$ "), F.col("o_custkey").cast("string")).alias("amount"),
        F.when(kind == 0, F.col("o_custkey").cast("string"))
        .when(kind == 1, F.lit("True"))
        .when(kind == 2, F.date_format(day, "dd-MM-yyyy"))
        .when(kind == 3, F.col("o_orderpriority"))
        .alias("mixed"),
    )


def file_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders seen as the file records of projects."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.col("o_custkey").cast("string").alias("project_id"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"),
        F.concat_ws("_", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("file"),
        F.when(F.col("o_orderstatus") == "O", "csv").otherwise("text").alias("type"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 11 == 0).alias("is_deleted"),
        (F.col("o_orderkey") % 13 == 0).alias("is_sample"),
    )


def lineitem_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a discount that is no number."""
    discount = F.when(F.col("l_discount") == 0.05, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return table(spark, folder, "lineitem").withColumn("l_discount", discount)


def lineitem_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a key that is missing for some rows and alike for others."""
    return table(spark, folder, "lineitem").select(
        F.nullif("l_linenumber", F.lit(1)).alias("k"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )


# --- scalars --------------------------------------------------------------------------------


@_query
def nullify_nonfinite(spark: SparkSession, folder: str) -> DataFrame:
    broken = table(spark, folder, "lineitem").select(
        *LINEITEM_KEY,
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_tax") == 0, F.lit(float("-inf"))).otherwise(F.col("l_tax")).alias("l_tax"),
    )
    return scalars.sanitize_nonfinite(broken)


@_query
def nullify_nan(spark: SparkSession, folder: str) -> DataFrame:
    broken = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias(" c_acctbal "),
    )
    return scalars.trim_headers(scalars.nullify(broken))


@_query
def strip_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", scalars.strip_numeric(F.col("props")).alias("number")
    )


@_query
def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return order_texts(spark, folder).select(
        "o_orderkey",
        scalars.coerce_numeric(F.col("mixed")).alias("number"),
        scalars.coerce_numeric(F.col("amount")).alias("unread"),
    )


@_query
def classify_extension(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id",
        scalars.classify_extension(F.col("url")).alias("kind"),
        scalars.classify_extension(
            F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(".tar.jpeg"))
        ).alias("kind_of_copy"),
    )


@_query
def normalize_key(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("  "))
    return table(spark, folder, "customer").select("c_custkey", scalars.normalize_key(padded).alias("key"))


@_query
def is_date_text(spark: SparkSession, folder: str) -> DataFrame:
    return order_texts(spark, folder).select(
        "o_orderkey",
        scalars.is_date_text(F.col("some_day")).alias("some_day"),
        scalars.is_date_text(F.col("mixed")).alias("mixed"),
    )


@_query
def project_pair(spark: SparkSession, folder: str) -> DataFrame:
    return series.numeric_pair(lineitem_gaps(spark, folder), "l_discount", "l_tax")


# --- roles ----------------------------------------------------------------------------------


@_query
def column_roles(spark: SparkSession, folder: str) -> DataFrame:
    return roles.column_roles(order_texts(spark, folder), "o_orderkey")


@_query
def role_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _joined_arrays(roles.role_counts(table(spark, folder, "orders"), "o_orderkey"))


@_query
def header_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = roles.header_summary(order_texts(spark, folder), "o_orderkey")
    return _joined_arrays(summary.drop("header_label"))


def _joined_arrays(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


@_query
def date_columns(spark: SparkSession, folder: str) -> DataFrame:
    return roles.date_columns(order_texts(spark, folder))


def written_days(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their day written in a dozen ways in one column, and with a column that has a word among them."""
    minutes = (F.col("o_orderkey") * 37 % 1440).cast("int")
    day = F.col("o_orderdate") + F.make_interval(mins=minutes)
    number = F.dayofmonth(day)
    suffix = F.when(number.isin(11, 12, 13), "th").otherwise(F.element_at(F.array(*[F.lit(x) for x in ["th", "st", "nd", "rd", *["th"] * 6]]), number % 10 + 1))
    ways = [
        F.date_format(day, "yyyy-M-d"), F.date_format(day, "M/d/yyyy"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "MMM. d, yyyy"),
        F.concat(F.date_format(day, "EEEE, MMMM d"), suffix, F.date_format(day, ", yyyy")),
        F.concat(F.date_format(day, "d"), suffix, F.date_format(day, "' of 'MMMM yyyy")), F.upper(F.date_format(day, "d-MMM-yy")),
        F.date_format(day, "yyyy MMM d h:mm a"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(day, "EEE d MMM yyyy HH:mm"),
        F.date_format(day, "yyyy/M/d' at 'h a"), F.date_format(day, "yyyy.MM.dd HH:mm:ss.SSS"),
    ]
    written = F.element_at(F.array(*ways), (F.col("o_orderkey") % len(ways) + 1).cast("int"))
    other = F.when(F.col("o_orderkey") % 100 == 7, F.lit("2nd quarter")).otherwise(written)
    return table(spark, folder, "orders").select("o_orderkey", written.alias("written"), other.alias("other"))


@_query
def free_dates(spark: SparkSession, folder: str) -> DataFrame:
    days = written_days(spark, folder).drop("other")
    read = roles.parse_dates(days, roles.date_formats(days))
    return read.select("o_orderkey", F.date_format("written", "yyyy-MM-dd HH:mm:ss").alias("written"))


@_query
def free_date_columns(spark: SparkSession, folder: str) -> DataFrame:
    return roles.date_columns(written_days(spark, folder))


@_query
def typed_by_role(spark: SparkSession, folder: str) -> DataFrame:
    return roles.typed_by_role(order_texts(spark, folder).select("o_orderkey", "amount", "lettered"), "o_orderkey")


@_query
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    texts = order_texts(spark, folder).select("o_orderkey", "iso_day", "us_day", "long_day")
    parsed = roles.parse_dates(texts, roles.date_formats(texts))
    return parsed.select(
        "o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("iso_day", "us_day", "long_day")]
    )


@_query
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return roles.dataset_summary(table(spark, folder, "lineitem"), "parquet")


# --- quality and cleansing ------------------------------------------------------------------


@_query
def missing_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality.missing_rows(lineitem_gaps(spark, folder))


@_query
def delete_missing_row(spark: SparkSession, folder: str) -> DataFrame:
    return cleanse.delete_missing_row(lineitem_gaps(spark, folder))


@_query
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    return cleanse.drop_missing(lineitem_gaps(spark, folder), ["l_tax"])


@_query
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_rows(table(spark, folder, "documents").select("text", "lang"))


@_query
def duplicate_rows_many_copies(spark: SparkSession, folder: str) -> DataFrame:
    narrow = lineitem_gaps(spark, folder).select("l_returnflag", "l_linenumber", "l_tax")
    return quality.duplicate_rows(narrow)


@_query
def duplicate_rows_by_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return quality.duplicate_rows(documents, "text", "doc_id").drop("text")


@_query
def duplicate_rows_tied_key(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_rows(lineitem_ties(spark, folder), "l_orderkey", "k")


@_query
def delete_duplicate_row_tied_key(spark: SparkSession, folder: str) -> DataFrame:
    return cleanse.delete_duplicate_row(lineitem_ties(spark, folder), "l_orderkey", "k")


@_query
def delete_duplicate_row_whole(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return cleanse.delete_duplicate_row(lines.union(lines.filter("l_quantity < 10")))


@_query
def duplicate_rows_whole(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return quality.duplicate_rows(lines.union(lines.filter("l_quantity < 10")))


@_query
def delete_duplicate_row(spark: SparkSession, folder: str) -> DataFrame:
    return cleanse.delete_duplicate_row(lineitem_gaps(spark, folder).select("l_returnflag", "l_linenumber", "l_tax"))


@_query
def delete_duplicate_row_by_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    return cleanse.delete_duplicate_row(documents, "text", "doc_id").drop("text")


@_query
def iqr_bounds(spark: SparkSession, folder: str) -> DataFrame:
    bounds = quality.iqr_bounds(table(spark, folder, "lineitem"), LINEITEM_MEASURES)
    return rounded(bounds, 6, "q1", "q3", "lower", "upper")


@_query
def iqr_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.iqr_outliers(table(spark, folder, "events"), "value").select("event_id", "value")


@_query
def zscore_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.zscore_outliers(table(spark, folder, "events"), "value").select("event_id", "value")


@_query
def outlier_values(spark: SparkSession, folder: str) -> DataFrame:
    return quality.outlier_values(table(spark, folder, "events"))


@_query
def quality_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.nullif("event_type", F.lit("view")).alias("event_type"), "value", F.col("user_id")
    )
    return quality.quality_counts(events)


@_query
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(lineitem_gaps(spark, folder).select("l_returnflag", "l_linenumber", "l_tax"))


@_query
def quality_counts_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of a table some of whose rows occur twice."""
    lines = table(spark, folder, "lineitem")
    return quality.quality_counts(lines.union(lines.filter("l_quantity < 10")))


@_query
def quality_report_whole(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "orders"))


@_query
def delete_row_outlier_whole(spark: SparkSession, folder: str) -> DataFrame:
    return cleanse.delete_row_outlier(table(spark, folder, "lineitem"))


@_query
def delete_row_outlier(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return cleanse.delete_row_outlier(events)


@_query
def impute_by_mean(spark: SparkSession, folder: str) -> DataFrame:
    filled = cleanse.impute_by_mean(customer_gaps(spark, folder), "c_acctbal")
    return rounded(filled, 6, "c_acctbal")


@_query
def impute_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    return cleanse.impute_by_mode(lineitem_gaps(spark, folder), ["l_discount", "l_tax", "l_returnflag"])


@_query
def column_modes(spark: SparkSession, folder: str) -> DataFrame:
    modes = cleanse.column_modes(table(spark, folder, "part"), ["p_brand", "p_size", "p_retailprice"])
    return modes.drop("moment")


@_query
def convert_types(spark: SparkSession, folder: str) -> DataFrame:
    texts = order_texts(spark, folder).select("o_orderkey", "mixed", "iso_day")
    return cleanse.convert_types(texts, {"mixed": "bigint", "iso_day": "date", "o_orderkey": "double"})


@_query
def remove_missing_cell(spark: SparkSession, folder: str) -> DataFrame:
    return cleanse.remove_missing_cell(customer_gaps(spark, folder), "c_custkey")


@_query_as("cleanse")
def cleanse_steps(spark: SparkSession, folder: str) -> DataFrame:
    narrow = lineitem_gaps(spark, folder).select("l_returnflag", "l_linenumber", "l_tax", "l_discount")
    return cleanse.cleanse(narrow, ["delete_duplicate_row", "delete_missing_row"])


@_query
def cleanse_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Three steps over all columns of a table with gaps and copies."""
    lines = lineitem_gaps(spark, folder).drop("l_returnflag")
    steps = ["delete_missing_row", "delete_duplicate_row", "delete_row_outlier"]
    return cleanse.cleanse(lines.union(lines.filter("l_linenumber = 1")), steps)


# --- KPI ------------------------------------------------------------------------------------


def _cards(df: DataFrame) -> DataFrame:
    return rounded(df, 4, "value").drop("value_text")


def _number_card(aggregation: str) -> Query:
    def make(spark: SparkSession, folder: str) -> DataFrame:
        fields = ["c_acctbal", "c_custkey"]
        return _cards(kpi.kpi_number(customer_gaps(spark, folder), aggregation, fields))

    make.__name__ = f"kpi_number_{aggregation}"
    return _query(make)


def _category_card(aggregation: str) -> Query:
    def make(spark: SparkSession, folder: str) -> DataFrame:
        orders = table(spark, folder, "orders")
        fields = ["o_orderpriority", "o_orderstatus"]
        return kpi.kpi_category(orders, aggregation, fields, "o_orderkey").drop("value_text")

    make.__name__ = f"kpi_category_{aggregation}"
    return _query(make)


for _aggregation in (
    "sum",
    "average",
    "count",
    "minimum",
    "maximum",
    "std_deviation",
    "variance",
    "median",
    "count_distinct",
):
    _number_card(_aggregation)
for _aggregation in ("first", "last", "count", "count_distinct"):
    _category_card(_aggregation)


@_query
def kpi_cards(spark: SparkSession, folder: str) -> DataFrame:
    return _cards(kpi.kpi_cards(table(spark, folder, "lineitem"), "number", "average", LINEITEM_MEASURES))


@_query
def cards_of_raw_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = order_texts(spark, folder).select("o_orderkey", "amount", "lettered")
    return _cards(requests.cards_of(texts, "number", "sum", ["amount", "lettered"], order_by="o_orderkey"))


# --- grouping and charts --------------------------------------------------------------------


@_query
def group_sum(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.group_sum(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"), 2, "sum")


@_query
def group_sum_by_value(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    return rounded(series.group_sum(lineitem, "l_partkey", "l_quantity", 25, order="value"), 2, "sum")


@_query
def group_sum_all(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.group_sum(table(spark, folder, "events"), "user_id", "props", None), 2, "sum")


@_query
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return series.value_counts(table(spark, folder, "events"), "user_id")


def _by_day(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


@_query
def chart_line(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.chart(_by_day(spark, folder), "line_chart", "day", "value"), 2, "sum")


@_query
def chart_scatter(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.chart(table(spark, folder, "part"), "scatter_plot", "p_size", "p_retailprice"), 2, "sum")


@_query
def chart_bar(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.chart(table(spark, folder, "lineitem"), "bar_chart", "l_returnflag", "l_quantity"), 2, "sum")


@_query
def chart_column(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return rounded(series.chart(orders, "column_chart", "o_orderpriority", "o_totalprice"), 2, "sum")


@_query
def chart_pie(spark: SparkSession, folder: str) -> DataFrame:
    return series.chart(table(spark, folder, "events"), "pie_chart", "event_type")


@_query
def chart_donut(spark: SparkSession, folder: str) -> DataFrame:
    return series.chart(table(spark, folder, "part"), "donut_chart", "p_brand")


@_query
def chart_area(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return series.chart(orders, "area_chart", "o_orderkey", "o_totalprice", order_by="o_orderkey")


@_query
def chart_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = lineitem_gaps(spark, folder)
    return series.chart(lineitem, "heatmap", "l_discount", "l_tax", order_by=LINEITEM_KEY)


@_query
def chart_bubble(spark: SparkSession, folder: str) -> DataFrame:
    bubbles = series.chart(table(spark, folder, "part"), "bubble_chart", "p_brand", "p_size")
    return rounded(bubbles, 6, "sum", "size", "colour", "y_low", "y_high")


@_query
def chart_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    steps = series.chart(table(spark, folder, "orders"), "waterfall", "o_orderpriority", "o_totalprice")
    return rounded(steps, 2, "value", "start", "end")


@_query
def waterfall_all_groups(spark: SparkSession, folder: str) -> DataFrame:
    steps = series.waterfall_series(table(spark, folder, "lineitem"), "l_partkey", "l_extendedprice", None)
    return rounded(steps, 2, "value", "start", "end")


@_query
def chart_radar(spark: SparkSession, folder: str) -> DataFrame:
    radar = series.chart(table(spark, folder, "part"), "radar_chart", "p_size", "p_retailprice")
    return rounded(rounded(radar, 2, "sum"), 6, "scaled")


@_query
def chart_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = series.chart(table(spark, folder, "lineitem"), "histogram", "l_discount")
    return rounded(bins, 9, "left_value", "right_value")


@_query
def chart_of_raw_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = order_texts(spark, folder).select("o_orderkey", "some_day", "amount")
    return requests.chart_of(texts, "bar_chart", "some_day", "amount", order_by="o_orderkey")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    placed = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return placed.select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("place"), "c_acctbal")


def _countries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").filter("n_regionkey <> 0").select(F.col("n_name").alias("NAME"))


@_query
def map_join(spark: SparkSession, folder: str) -> DataFrame:
    return series.map_series(_places(spark, folder), "place", "c_acctbal", _countries(spark, folder))


@_query
def map_summary(spark: SparkSession, folder: str) -> DataFrame:
    return series.map_summary(_places(spark, folder), "place", "c_acctbal", _countries(spark, folder))


@_query
def unmatched_places(spark: SparkSession, folder: str) -> DataFrame:
    return series.unmatched_places(_places(spark, folder), "place", _countries(spark, folder))


# --- histograms -----------------------------------------------------------------------------


def _bins(method: str) -> Query:
    def make(spark: SparkSession, folder: str) -> DataFrame:
        return histogram.bin_count(table(spark, folder, "lineitem"), BIN_COLUMNS, method)

    make.__name__ = f"bin_count_{method}"
    return _query(make)


for _method in ("fd", "sturges", "rice", "sqrt", "doane", "scott", "custom"):
    _bins(_method)


@_query
def histogram_fd(spark: SparkSession, folder: str) -> DataFrame:
    bins = histogram.histogram(table(spark, folder, "lineitem"), BIN_COLUMNS)
    return rounded(bins, 6, "left_value", "right_value")


@_query
def histogram_sturges(spark: SparkSession, folder: str) -> DataFrame:
    bins = histogram.histogram(table(spark, folder, "events"), "value", "sturges")
    return rounded(bins, 6, "left_value", "right_value")


@_query
def histogram_far_value(spark: SparkSession, folder: str) -> DataFrame:
    """One value far beyond the others asks for very many bins; only filled ones are listed."""
    value = F.when(F.col("o_orderkey") == 1, F.lit(1e13)).otherwise(F.col("o_totalprice"))
    orders = table(spark, folder, "orders").select(value.alias("price"))
    return histogram.histogram(orders, "price", filled_only=True).agg(
        F.sum("count").alias("n"), F.max("right_value").alias("hi"), (F.max("index") > 1_000_000).alias("many")
    )


@_query
def datetime_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return histogram.datetime_histogram(table(spark, folder, "orders"), "o_orderdate").drop("label")


# --- profile --------------------------------------------------------------------------------


@_query
def profile_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_counts(lineitem_gaps(spark, folder))


@_query
def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    numbers = profile.profile_numeric(lineitem_gaps(spark, folder))
    return rounded(numbers, 4, "mean", "standard_deviation")


@_query
def quantiles(spark: SparkSession, folder: str) -> DataFrame:
    found = profile.quantiles(table(spark, folder, "lineitem"), ["l_orderkey", *LINEITEM_MEASURES])
    return rounded(found, 6, "value")


@_query
def profile_string(spark: SparkSession, folder: str) -> DataFrame:
    texts = profile.profile_string(table(spark, folder, "part"))
    shown = F.transform("counts", lambda c: F.concat(c["key"], F.lit("="), c["value"].cast("string")))
    return texts.withColumn("counts", F.array_join(shown, ";"))


@_query
def top_values(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(table(spark, folder, "events"), ["event_type", "props"])


@_query
def top_values_long(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts of documents by frequency, beside short ones."""
    top = profile.top_values(table(spark, folder, "documents"), ["text", "lang", "source"])
    return top.withColumn("value", F.sha2("value", 256))


@_query
def top_values_once(spark: SparkSession, folder: str) -> DataFrame:
    """Long texts that mostly occur once: the smallest follow those that occur again."""
    pages = table(spark, folder, "pages")
    top = profile.top_values(pages.select("html").union(pages.filter("page_id < 3").select("html")), ["html"])
    return top.withColumn("value", F.sha2("value", 256))


@_query
def profile_datetime(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_datetime(table(spark, folder, "orders"))


@_query
def distinct_per_column(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_per_column(lineitem_gaps(spark, folder))


@_query_as("profile")
def profile_table(spark: SparkSession, folder: str) -> DataFrame:
    flat = profile.profile(table(spark, folder, "lineitem"))
    return rounded(flat, 4, "mean", "standard_deviation", "q1", "q2", "q3")


@_query
def profile_histograms(spark: SparkSession, folder: str) -> DataFrame:
    bins = profile.profile_histograms(table(spark, folder, "lineitem"), BIN_COLUMNS)
    return rounded(bins, 6, "q1", "q2", "q3", "left_value", "right_value")


@_query
def profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Nested documents, opened up far enough to compare them."""
    documents = profile.profile_documents(table(spark, folder, "orders"))
    info, metrics = F.col("table_column_info"), F.col("table_column_metrics")
    return documents.select(
        "name",
        info["order"].alias("position"),
        info["extended_type"].alias("extended_type"),
        metrics["valid_count"].alias("valid_count"),
        F.round(metrics["numeric_metrics"]["quantiles"][1]["value"], 4).alias("median"),
        F.size(metrics["numeric_metrics"]["histogram"]["buckets"]).alias("buckets"),
        _bucket_total(metrics["numeric_metrics"]).alias("binned"),
        metrics["string_metrics"]["most_common_value"].alias("most_common_value"),
        metrics["string_metrics"]["unique_value_count"].alias("unique_value_count"),
        metrics["date_time_metrics"]["minimum"].alias("earliest"),
        _bucket_total(metrics["date_time_metrics"]).alias("dated"),
    )


@_query
def profile_document_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The buckets inside the nested documents, edge by edge; the engines round a label's halves differently."""
    documents = profile.profile_documents(table(spark, folder, "orders"))
    numeric = F.col("table_column_metrics")["numeric_metrics"]["histogram"]["buckets"]
    rows = documents.select(F.col("name").alias("column"), F.inline(numeric)).drop("label")
    return rounded(rows, 6, "left_value", "right_value")


def _bucket_total(metrics: Column) -> Column:
    counts = F.transform(metrics["histogram"]["buckets"], lambda b: b["count"])
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, c: total + c)


@_query
def column_analysis(spark: SparkSession, folder: str) -> DataFrame:
    analysis = columns.column_analysis(table(spark, folder, "orders"), "o_orderkey")
    return analysis.withColumn("sample_values", F.array_join("sample_values", ";"))


@_query
def type_mix(spark: SparkSession, folder: str) -> DataFrame:
    return columns.type_mix(order_texts(spark, folder))


@_query
def group_sum_nan(spark: SparkSession, folder: str) -> DataFrame:
    return series.group_sum(lineitem_nan(spark, folder), "l_discount", "l_quantity", None)


@_query
def value_counts_nan(spark: SparkSession, folder: str) -> DataFrame:
    return series.value_counts(lineitem_nan(spark, folder), "l_discount", None)


@_query
def kpi_distinct_nan(spark: SparkSession, folder: str) -> DataFrame:
    lines = lineitem_nan(spark, folder)
    texts = kpi.kpi_category(lines, "count_distinct", ["l_discount", "l_returnflag"]).select("field", "value")
    numbers = kpi.kpi_number(lines, "count_distinct", "l_discount")
    return texts.union(numbers.select("field", F.col("value").cast("bigint").cast("string")))


@_query
def map_summary_nan(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    balance = F.when(F.col("c_acctbal") > 5000, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    places = people.select(F.col("n_name").alias("Country"), balance.alias("balance"))
    return series.map_summary(places, "Country", "balance", table(spark, folder, "nation").select(F.col("n_name").alias("Country")))


@_query
def share_series_all(spark: SparkSession, folder: str) -> DataFrame:
    return series.share_series(table(spark, folder, "part"), "p_brand", None)


@_query
def radar_all(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.radar_series(table(spark, folder, "orders"), "o_custkey", "o_totalprice", None), 6, "sum", "scaled")


@_query
def date_flags(spark: SparkSession, folder: str) -> DataFrame:
    texts = order_texts(spark, folder)
    names = ["iso_day", "us_day", "some_day", "lettered"]
    return reshape.literal_rows(spark, [{"column": c, "is_date": roles.is_date_column(texts, c)} for c in names])


# --- paging ---------------------------------------------------------------------------------

NEWEST_FIRST: Names = ["-o_totalprice", "o_orderkey"]
# Tells all rows of lineitem apart.
DEEP_ORDER = ["-l_shipdate", "l_orderkey", "-l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@_query
def page_slice(spark: SparkSession, folder: str) -> DataFrame:
    return paging.page_slice(table(spark, folder, "orders"), NEWEST_FIRST, 3, 100)


@_query
def page_after(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return paging.page_after(orders, ["o_custkey", "o_orderkey"], {"o_custkey": 70, "o_orderkey": 500}, 40)


@_query
def page_from_index(spark: SparkSession, folder: str) -> DataFrame:
    path = shared.fresh_path(spark, "page-index")
    paging.write_page_index(table(spark, folder, "orders"), NEWEST_FIRST, path)
    return paging.read_page(spark, path, 5, 250)


@_query
def page_info(spark: SparkSession, folder: str) -> DataFrame:
    return paging.page_info(table(spark, folder, "orders"), 2, 64)


@_query
def page_info_large(spark: SparkSession, folder: str) -> DataFrame:
    return paging.page_info(table(spark, folder, "lineitem"), 1, 3_000_000)


@_query
def page_slice_large(spark: SparkSession, folder: str) -> DataFrame:
    return paging.page_slice(table(spark, folder, "customer"), "c_custkey", 1, 3_000_000, max_size=None)


@_query
def page_slice_deep(spark: SparkSession, folder: str) -> DataFrame:
    """A page beyond the rows that one task may keep."""
    return paging.page_slice(table(spark, folder, "lineitem"), DEEP_ORDER, 55, 100, narrow=500)


@_query
def page_list(spark: SparkSession, folder: str) -> DataFrame:
    return paging.page_list(table(spark, folder, "orders"), 64)


@_query
def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    return paging.floats_as_text(paging.head_rows(table(spark, folder, "customer"), 20, "c_custkey"))


@_query
def list_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return paging.list_sorted(table(spark, folder, "supplier"), "-s_acctbal")


@_query
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return paging.latest_per_key(table(spark, folder, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


@_query
def find_record(spark: SparkSession, folder: str) -> DataFrame:
    return paging.find_record(file_records(spark, folder), "70", "f9.csv").select("_id", "filename", "project_id")


@_query
def search_files(spark: SparkSession, folder: str) -> DataFrame:
    return paging.search_files(file_records(spark, folder), "UrGent", "csv").select("_id", "file", "type")


@_query
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    return paging.search_text(table(spark, folder, "part"), "p_name", "RiNg").select("p_partkey", "p_name")


@_query
def active_records(spark: SparkSession, folder: str) -> DataFrame:
    return paging.active(file_records(spark, folder)).select("_id", "project_id")


@_query
def files_of_project(spark: SparkSession, folder: str) -> DataFrame:
    return paging.files_of_project(file_records(spark, folder), "70").select("_id", "filename")


@_query
def files_of_projects(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    projects = customer.select(F.col("c_custkey").cast("string").alias("_id"))
    return paging.files_of_projects(file_records(spark, folder), projects).select("_id", "filename")


# --- sources and sinks ----------------------------------------------------------------------


@_query_as("html_tables")
def html_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with a table put before its own text; the rest of the page holds none."""
    lead = F.concat(
        F.lit("<table><tr><th>Page</th><th>Address</th></tr><tr></tr><tr><td> "),
        F.col("page_id").cast("string"),
        F.lit(" <td>&lt;"),
        F.col("url"),
        F.lit("&gt;</tr></table><TABLE><tr><td>"),
        F.length("url").cast("string"),
        F.lit("</td></tr></TABLE>"),
    )
    pages = table(spark, folder, "pages").select("page_id", F.concat(lead, F.col("html")).alias("html"))
    rows = html_tables.extract_html_tables(pages)
    return rows.withColumn("cells", F.array_join("cells", "|"))


@_query
def widen_table_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One table per order, its second row shorter than the first."""
    row = F.concat(
        F.lit("<table><tr><td>"),
        F.col("o_orderstatus"),
        F.lit("</td><td>"),
        F.col("o_orderpriority"),
        F.lit("</td></tr><tr><td>"),
        F.col("o_custkey").cast("string"),
        F.lit("</td></tr></table>"),
    )
    pages = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page_id"), row.alias("html"))
    return html_tables.widen_table_cells(html_tables.extract_html_tables(pages))


@_query
def cleansed_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Cleansed, written and read again."""
    path = shared.fresh_path(spark, "cleansed")
    writers.write_cleansed(cleanse.cleanse(customer_gaps(spark, folder), ["delete_missing_row"]), path)
    return readers.read_csv(spark, path)


@_query
def csv_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Line breaks, quotes and separators inside cells, written and read again."""
    path = shared.fresh_path(spark, "broken-lines")
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('",;'), F.col("c_nationkey").cast("string"), F.lit("\n"))
    customers = table(spark, folder, "customer").select("c_custkey", note.alias("note"), "c_acctbal")
    writers.write_cleansed(customers, path)
    return readers.read_csv(spark, path)


@_query
def scraped_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of different widths in one crawl, pages by address, written and read again."""
    path = shared.fresh_path(spark, "scraped")
    page = F.concat(
        F.lit("<table><tr><td>"), F.col("o_orderpriority"), F.lit("</table><table><tr><td>a, b<td>c<td>"),
        F.col("o_orderkey").cast("string"), F.lit("<tr><td>short</table>"),
    )
    address = F.concat(F.lit("p-"), F.col("o_orderkey").cast("string"))
    pages = table(spark, folder, "orders").select(address.alias("page_id"), page.alias("html"))
    writers.write_tables(html_tables.extract_html_tables(pages), path, folder_per_table=False)
    return spark.read.text(path)


@_query
def json_document(spark: SparkSession, folder: str) -> DataFrame:
    """Files that each hold one document of up to 500 customers."""
    path = shared.fresh_path(spark, "document")
    record = F.struct("c_custkey", "c_name", "c_acctbal")
    documents = table(spark, folder, "customer").groupBy(F.floor(F.col("c_custkey") / 500)).agg(F.to_json(F.collect_list(record)).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_document(spark, path)


@_query
def delimited_file(spark: SparkSession, folder: str) -> DataFrame:
    """Written with another separator and read back without naming it."""
    path = shared.fresh_path(spark, "delimited")
    table(spark, folder, "part").select("p_partkey", "p_brand", "p_size").write.csv(path, header=True, sep=";")
    return readers.read_delimited(spark, path)


@_query
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = shared.fresh_path(spark, "lines")
    customer_gaps(spark, folder).write.json(path)
    return readers.read_json_lines(spark, path).select("c_custkey", "c_acctbal", "c_mktsegment")


@_query
def stored_profiles(spark: SparkSession, folder: str) -> DataFrame:
    path = shared.fresh_path(spark, "profiles")
    for name in ("orders", "customer"):
        writers.append_profile(profile.profile_counts(table(spark, folder, name)), name, "tpch", path)
    return writers.find_profiles(spark, path, file_id="orders", project_id="tpch").select(
        "file_id", "project_id", "metadata.*"
    )


@_query
def stored_profile_by_id(spark: SparkSession, folder: str) -> DataFrame:
    path = shared.fresh_path(spark, "profiles")
    writers.append_profile(profile.profile_counts(table(spark, folder, "orders")), "orders", "tpch", path)
    wanted = writers.find_profiles(spark, path).filter(F.col("metadata")["column"] == "o_custkey").first()["_id"]
    return writers.profile_by_id(spark, path, wanted).select("file_id", "metadata.column", "metadata.total_count")


@_query
def cleansed_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Cleansed into a file, profiled from that file, stored and looked up."""
    path = shared.fresh_path(spark, "request")
    requests.cleanse_and_profile(
        customer_gaps(spark, folder), f"{path}/csv", f"{path}/store", file_id="c", project_id="p"
    )
    metadata = F.col("metadata")
    return writers.find_profiles(spark, f"{path}/store", file_id="c").select(
        metadata["name"].alias("name"),
        metadata["table_column_info"]["type"].alias("type"),
        metadata["table_column_metrics"]["total_count"].alias("total_count"),
        F.round(metadata["table_column_metrics"]["numeric_metrics"]["quantiles"][0]["value"], 4).alias("q1"),
        metadata["table_column_metrics"]["string_metrics"]["unique_value_count"].alias("unique_value_count"),
    )


# --- streams --------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@_query
def stream_profile(spark: SparkSession, folder: str) -> DataFrame:
    result = running.stream_profile(_event_stream(spark, folder), ["value", "user_id"])
    final = running.run_to_end(result, "stream-profile")
    return rounded(final, 2, "total", "total_squares", "mean", "standard_deviation")


@_query
def stream_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    result = running.stream_value_counts(_event_stream(spark, folder), "event_type")
    return running.run_changes_to_end(result, "event_type", "stream-counts")
