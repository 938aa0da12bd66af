"""The data behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions import fixed
from tabscope.functions.reshape import as_text
from tabscope.functions.scalars import (
    Names,
    as_number,
    field_type,
    known,
    normalize_key,
    order_columns,
    ref,
)
from tabscope.operators.histogram import fixed_histogram
from tabscope.operators.ranges import running_sums


def group_sum(
    df: DataFrame, key: str, value: str, limit: int | None = fixed.CHART_GROUPS, *, order: str = "key"
) -> DataFrame:
    """``(<key>, sum)``: sum per group for the first groups in key order.

    Text values are stripped to digits and dots first. Groups without a key (NaN is none) vanish; a group without
    a readable value sums to zero. ``order="value"`` takes the largest sums instead.
    """
    field_type(df, key)
    if order not in ("key", "value"):
        raise ValueError(f"Unknown order: {order}")
    summed = (
        df.select(known(df, key).alias(key), as_number(df, value, strip=True).alias("_value"))
        .filter(ref(key).isNotNull())
        .groupBy(ref(key))
        .agg(F.coalesce(F.sum("_value"), F.lit(0.0)).alias("sum"))
    )
    ordering = [ref(key).asc()] if order == "key" else [F.col("sum").desc(), ref(key).asc()]
    return summed.orderBy(*ordering) if limit is None else summed.orderBy(*ordering).limit(limit)


def value_counts(df: DataFrame, column: str, limit: int | None = fixed.CHART_GROUPS) -> DataFrame:
    """``(<column>, count)``: most frequent values; equal counts in value order."""
    field_type(df, column)
    present = df.select(known(df, column).alias(column)).filter(ref(column).isNotNull())
    counted = present.groupBy(ref(column)).agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.col("count").desc(), ref(column).asc())
    return ordered if limit is None else ordered.limit(limit)


def share_series(df: DataFrame, column: str, limit: int | None = fixed.CHART_GROUPS) -> DataFrame:
    """``(<column>, count, percent)``: slices of a pie or donut, percent of the slices shown."""
    shown = value_counts(df, column, limit)
    total = shown.agg(F.sum("count")).scalar()
    return shown.withColumn("percent", F.round(F.col("count") * 100.0 / total, 1))


def area_series(df: DataFrame, x: str, y: str, order_by: Names, limit: int = fixed.CHART_GROUPS) -> DataFrame:
    """The first pairs in row order, not summed up."""
    pairs = df.orderBy(*order_columns(order_by)).limit(limit)
    return pairs.select(ref(x).alias(x), ref(y).alias(y))


def numeric_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two columns as numbers, complete rows only."""
    pair = df.select(as_number(df, x).alias(x), as_number(df, y).alias(y))
    return pair.filter(ref(x).isNotNull() & ref(y).isNotNull())


def heatmap_pairs(
    df: DataFrame, x: str, y: str, order_by: Names, limit: int | None = fixed.HEATMAP_ROWS
) -> DataFrame:
    """The first complete numeric pairs in row order."""
    a, b = as_number(df, x), as_number(df, y)
    complete = df.filter(a.isNotNull() & b.isNotNull()).orderBy(*order_columns(order_by))
    shown = complete if limit is None else complete.limit(limit)
    return shown.select(a.alias(x), b.alias(y))


def bubble_series(df: DataFrame, x: str, y: str, limit: int | None = fixed.CHART_GROUPS) -> DataFrame:
    """``(<x>, sum, size, colour, y_low, y_high)``."""
    # Size factor and its limits, margins of the axis.
    factor, smallest, largest, below, above = 10, 50, 2000, 0.9, 1.1
    sums = group_sum(df, x, y, limit)
    size = F.greatest(F.least(F.col("sum") * factor, F.lit(float(largest))), F.lit(float(smallest)))
    low, high = _range_of(sums)
    return sums.select(
        ref(x).alias(x),
        "sum",
        size.alias("size"),
        F.coalesce(F.try_divide(F.col("sum") - low, high - low), F.lit(0.0)).alias("colour"),
        (low * below).alias("y_low"),
        (high * above).alias("y_high"),
    )


def _range_of(sums: DataFrame) -> tuple[Column, Column]:
    """Lowest and highest sum, from one aggregated row."""
    ends = sums.agg(F.struct(F.min("sum").alias("low"), F.max("sum").alias("high"))).scalar()
    return ends["low"], ends["high"]


def waterfall_series(df: DataFrame, x: str, y: str, limit: int | None = fixed.CHART_GROUPS) -> DataFrame:
    """``(position, <x>, measure, value, start, end)``: stacked steps and a total at the end.

    Every step starts where the one before ends. ``limit=None`` stacks all groups; however many there are, no task sees
    more than a range of them.
    """
    if limit is not None and limit < 1:
        raise ValueError("a waterfall needs at least one step")
    steps = group_sum(df, x, y, limit).select(as_text(df, x).alias("_x"), "sum", ref(x).alias("_key"))
    stacked = running_sums(steps, [F.col("_key").asc()], "sum").select(
        F.col("position").cast("int").alias("position"), "_x", F.lit("relative").alias("measure"), F.col("sum").alias("value"), "end", F.col("size").alias("_n")
    )
    # The last step also carries the total.
    step = F.struct(
        "position",
        F.col("_x").alias("x"),
        "measure",
        "value",
        (F.col("end") - F.col("value")).alias("start"),
        "end",
    )
    total = F.struct(
        (F.col("position") + 1).alias("position"),
        F.lit("total").alias("x"),
        F.lit("total").alias("measure"),
        F.col("end").alias("value"),
        F.lit(0.0).alias("start"),
        "end",
    )
    rows = F.when(F.col("position") == F.col("_n"), F.array(step, total)).otherwise(F.array(step))
    return stacked.select(F.inline(rows)).withColumnRenamed("x", x)


def radar_series(df: DataFrame, x: str, y: str, limit: int | None = fixed.CHART_GROUPS) -> DataFrame:
    """``(<x>, sum, scaled)``: group sums as a share of the largest one."""
    sums = group_sum(df, x, y, limit)
    _, high = _range_of(sums)
    return sums.withColumn("scaled", F.coalesce(F.try_divide(F.col("sum"), high), F.lit(0.0)))


def histogram_series(df: DataFrame, x: str, bins: int = fixed.CHART_BINS) -> DataFrame:
    """``(index, left_value, right_value, count)`` in equal-width bins."""
    return fixed_histogram(df, x, bins, strip=True).select("index", "left_value", "right_value", "count")


# --- map ------------------------------------------------------------------------------------


def find_location_column(df: DataFrame, name: str = "Country") -> str | None:
    """The named column, else the first that usually holds country names."""
    if name in df.columns:
        return name
    return next((c for c in fixed.LOCATION_COLUMNS if c in df.columns), None)


def _matched(df: DataFrame, x: str, y: str, countries: DataFrame) -> DataFrame:
    place, known_place = find_location_column(df, x), find_location_column(countries)
    if place is None:
        raise ValueError(f"no column of the data holds places: {x}")
    if known_place is None:
        raise ValueError(f"the known countries have no column of names: {countries.columns}")
    # Rows without a value are dropped after the outer join, which makes it an inner one. How the
    # country side travels is left to its size at run time: no hint.
    left = countries.select(normalize_key(ref(known_place)).alias("Country"))
    right = df.select(normalize_key(ref(place)).alias("Country"), known(df, y).alias(y))
    return left.join(right.filter(ref(y).isNotNull()), "Country")


def map_series(df: DataFrame, x: str, y: str, countries: DataFrame, *, strict: bool = False) -> DataFrame:
    """``(Country, <y>)``: one row per country and matching row of the data, highest value first.

    ``strict`` looks for one match right away and raises when there is none.
    """
    matched = _matched(df, x, y, countries)
    if strict and matched.isEmpty():
        raise ValueError("no place of the data is a known country")
    return matched.orderBy(ref(y).desc(), "Country")


def map_summary(df: DataFrame, x: str, y: str, countries: DataFrame) -> DataFrame:
    """``(minimum, maximum, total_countries)`` of the matched rows."""
    return _matched(df, x, y, countries).agg(
        F.min(ref(y)).alias("minimum"),
        F.max(ref(y)).alias("maximum"),
        F.count(F.lit(1)).alias("total_countries"),
    )


def unmatched_places(df: DataFrame, x: str, countries: DataFrame) -> DataFrame:
    """``(Country, rows)``: places of the data that no known country matches."""
    place, known_place = find_location_column(df, x), find_location_column(countries)
    if place is None or known_place is None:
        raise ValueError("no location column")
    # Counted before the join, so that a frequent place travels once.
    counted = df.groupBy(normalize_key(ref(place)).alias("Country")).agg(F.count(F.lit(1)).alias("rows"))
    names = countries.select(normalize_key(ref(known_place)).alias("Country"))
    return counted.filter(F.col("Country").isNotNull()).join(names, "Country", "left_anti")


# --- dispatch -------------------------------------------------------------------------------


def chart(
    df: DataFrame,
    name: str,
    x: str,
    y: str | None = None,
    *,
    order_by: Names | None = None,
    countries: DataFrame | None = None,
) -> DataFrame:
    """The data of a chart by its name."""
    if name not in fixed.CHART_NAMES:
        raise ValueError(f"Unknown chart: {name}")
    if name in ("pie_chart", "donut_chart"):
        return share_series(df, x)
    if name == "histogram":
        return histogram_series(df, x)
    if y is None:
        raise ValueError(f"{name} needs a y axis")
    if name == "map_chart":
        if countries is None:
            raise ValueError("map_chart needs the known countries")
        return map_series(df, x, y, countries, strict=True)
    if name == "area_chart":
        return area_series(df, x, y, order_by or [])
    if name == "heatmap":
        return heatmap_pairs(df, x, y, order_by or [])
    builders = {
        "line_chart": group_sum,
        "bar_chart": group_sum,
        "scatter_plot": group_sum,
        "column_chart": group_sum,
        "waterfall": waterfall_series,
        "bubble_chart": bubble_series,
        "radar_chart": radar_series,
    }
    return builders[name](df, x, y)
