"""Column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import fixed
from tabscope.functions.reshape import literal_rows, long_numbers, long_text, long_typed, per_column, text_sql
from tabscope.functions.scalars import (
    SHORT_BYTES,
    Names,
    as_list,
    field_type,
    is_moment,
    iso_sql,
    known_sql,
    literal,
    number_sql,
    numeric_columns,
    quoted,
    short_sql,
)
from tabscope.operators.histogram import binned, datetime_histogram, rule_bins
from tabscope.operators.quantiles import exact_quantiles, quantile_table
from tabscope.operators.roles import date_formats, parse_dates

#: Keys of long texts that are sent to every task for a column at most; more are joined.
_SENT = 1000
QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def column_kind(df: DataFrame, name: str) -> str:
    """``NUMERIC``, ``DATE_TIME`` or ``STRING``, by type."""
    dtype = field_type(df, name)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "NUMERIC"
    return "DATE_TIME" if is_moment(dtype) else "STRING"


def extended_kind(df: DataFrame, name: str) -> str:
    kind = column_kind(df, name)
    if kind != "NUMERIC":
        return kind
    return "INTEGER" if isinstance(field_type(df, name), T.IntegralType) else "FLOAT"


def _of_kind(df: DataFrame, kind: str, columns: Names | None) -> list[str]:
    names = as_list(columns) or df.columns
    return [c for c in names if column_kind(df, c) == kind]


def _comparable(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if "map<" not in field_type(df, c).simpleString()]


# --- parts ----------------------------------------------------------------------------------


def _counts(df: DataFrame, name: str) -> dict[str, str]:
    valid = number_sql(df, name) if column_kind(df, name) == "NUMERIC" else known_sql(df, name)
    return {
        "total_count": "count(*)",
        "non_null_count": f"count({known_sql(df, name)})",
        "valid_count": f"count({valid})",
    }


def profile_counts(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, total_count, non_null_count, valid_count)``; infinities are present but not valid."""
    names = as_list(columns) or df.columns
    return per_column(df, [{"column": literal(c), **_counts(df, c)} for c in names])


def _moments(value: str) -> dict[str, str]:
    return {
        "finite_count": f"count({value})",
        "mean": f"avg({value})",
        "standard_deviation": f"stddev_pop({value})",
        "minimum": f"min({value})",
        "maximum": f"max({value})",
    }


def profile_numeric(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, finite_count, mean, standard_deviation, minimum, maximum)``, population deviation."""
    names = _of_kind(df, "NUMERIC", columns)
    return per_column(df, [{"column": literal(c), **_moments(number_sql(df, c))} for c in names])


def quantiles(
    df: DataFrame, columns: Names | None = None, points: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """``(column, point, value)``, exact."""
    names = as_list(columns) or numeric_columns(df)
    return exact_quantiles(df, names, points).select("column", "point", "value")


def _moment_parts(name: str) -> dict[str, str]:
    """Mean, summed exactly and cut to whole microseconds, and extremes as ISO text."""
    moment = f"CAST({quoted(name)} AS TIMESTAMP)"
    micros = f"CAST(unix_micros({moment}) AS DECIMAL(38, 0))"
    total, n = f"sum({micros})", f"CAST(count({micros}) AS DECIMAL(20, 0))"
    mean = f"timestamp_micros(CAST(try_divide({total} - pmod({total}, {n}), {n}) AS BIGINT))"
    return {"mean": iso_sql(mean), "minimum": iso_sql(f"min({moment})"), "maximum": iso_sql(f"max({moment})")}


def profile_datetime(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, mean, minimum, maximum)`` as ISO text."""
    names = _of_kind(df, "DATE_TIME", columns)
    return per_column(df, [{"column": literal(c), **_moment_parts(c)} for c in names])


def text_counts(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, value, count)`` of every present value."""
    names = _comparable(df, _of_kind(df, "STRING", columns))
    present = long_text(df, names).filter(F.col("value").isNotNull())
    return present.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns: Names | None = None, limit: int = fixed.TOP_VALUES) -> DataFrame:
    """``(column, position, value, count)``: most frequent values; equal counts in value order.

    The filter on the row number reaches below the shuffle: every task sends its best few only. Columns with long
    texts, which are looked up right away, are counted by digest.
    """
    return _ranked(df, columns, limit)[0]


def _ranked(df: DataFrame, columns: Names | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent values, and ``(column, unique_value_count)``."""
    names = _comparable(df, _of_kind(df, "STRING", columns))
    long = _long_columns(df, names)
    short = [c for c in names if c not in long]
    parts = []
    if short or not long:
        counted = text_counts(df, short)
        parts.append((_top(counted, limit), _unique(counted)))
    if long:
        counted = _keyed(df, long).groupBy("column", "key").agg(F.count(F.lit(1)).alias("count"))
        parts.append((_top_long(df, long, counted, limit), _unique(counted)))
    top, unique = zip(*parts, strict=True)
    return reduce(DataFrame.unionByName, top), reduce(DataFrame.unionByName, unique)


def _unique(counted: DataFrame) -> DataFrame:
    # Asking for the counts keeps both branches alike, so that they share one shuffle.
    return counted.groupBy("column").agg(F.expr("count_if(count > 0) AS unique_value_count"))


def _long_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Those that hold a text which would travel as a digest."""
    if not names:
        return []
    sizes = [F.expr(f"coalesce(max(octet_length({text_sql(df, c)})), 0) AS n{i}") for i, c in enumerate(names)]
    return [c for c, size in zip(names, df.agg(*sizes).first(), strict=True) if size > SHORT_BYTES]


def _keyed(df: DataFrame, names: list[str]) -> DataFrame:
    return long_text(df, names).filter("value IS NOT NULL").selectExpr("column", f"{short_sql('value')} AS key", "value")


def _top_long(df: DataFrame, names: list[str], counted: DataFrame, limit: int) -> DataFrame:
    """The most frequent values of columns with long texts; ``counted`` has ``(column, key, count)``.

    Texts are read again for the keys that may be among the first, and each task merges the copies of one. Only columns
    in which over :data:`_SENT` keys are equal at the end of the list are joined text by text. Where fewer
    values than wanted occur twice, the smallest of those that occur once follow: each task keeps its few smallest.
    """
    by_count = Window.partitionBy("column").orderBy(F.col("count").desc())
    repeated = counted.filter("count > 1")
    first = repeated.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= limit)
    floors = first.groupBy("column").agg(F.min("count").alias("floor"), F.count(F.lit(1)).alias("found"))
    # One row per column: equal counts at the end of the list are all looked at.
    wanted = repeated.join(F.broadcast(floors), "column").filter("count >= floor").select("column", "key", "count")
    sizes = wanted.groupBy("column").agg(F.count(F.lit(1)).alias("keys"))
    sized = wanted.join(F.broadcast(sizes), "column")
    few, more = (sized.filter(part).drop("keys") for part in (F.col("keys") <= _SENT, F.col("keys") > _SENT))
    rows = _keyed(df, names)
    beyond = more.agg((F.count(F.lit(1)) > 0).alias("beyond")).scalar()
    hits = rows.join(F.broadcast(few), ["column", "key"])  # at most _SENT rows per column
    hits = hits.unionByName(rows.filter(beyond).join(more, ["column", "key"]))
    out = hits.groupBy("column", "key").agg(F.min("value").alias("value"), F.max("count").alias("count")).drop("key")
    for c in names:
        found = floors.filter(F.col("column") == c).agg(F.coalesce(F.max("found"), F.lit(0)).alias("found")).scalar()
        known = first.filter(F.col("column") == c).select("key")  # at most ``limit`` rows
        once = _keyed(df, [c]).filter(found < limit).join(F.broadcast(known), "key", "left_anti")
        once = once.select("column", "value", F.lit(1).cast("bigint").alias("count"))
        out = out.unionByName(once.orderBy("value").limit(limit))
    return _top(out, limit)


def _top(counted: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    ranked = counted.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= limit)
    return ranked.select("column", "position", "value", "count")


def profile_string(df: DataFrame, columns: Names | None = None, limit: int = fixed.TOP_VALUES) -> DataFrame:
    """``(column, most_common_value, most_common_value_count, counts, unique_value_count)``."""
    best, unique = _ranked(df, columns, limit)
    entry = F.struct("position", F.col("value").alias("key"), F.col("count").alias("value"))
    top = best.groupBy("column").agg(F.sort_array(F.collect_list(entry)).alias("top"))
    return unique.join(F.broadcast(top), "column").select(  # one row per column
        "column",
        F.get("top", F.lit(0))["key"].alias("most_common_value"),
        F.get("top", F.lit(0))["value"].alias("most_common_value_count"),
        F.transform("top", lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value"))).alias("counts"),
        "unique_value_count",
    )


def distinct_per_column(df: DataFrame, columns: Names | None = None, *, approximate: bool = False) -> DataFrame:
    """``(column, unique_value_count)`` of present values."""
    names = as_list(columns) or _comparable(df, df.columns)
    if approximate:
        distinct = "approx_count_distinct({0})".format
        return per_column(
            df, [{"column": literal(c), "unique_value_count": distinct(known_sql(df, c))} for c in names]
        )
    # Every value meets its equals by hash, whatever the number of columns.
    counts = [
        values.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("found"))
        for values in long_typed(df, names, short=True).values()
    ]
    found = reduce(DataFrame.unionByName, counts)
    listed = literal_rows(df.sparkSession, [{"column": c} for c in names])
    return listed.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("found", F.lit(0)).alias("unique_value_count")
    )


# --- whole profile --------------------------------------------------------------------------


def with_dates(df: DataFrame) -> DataFrame:
    """Text columns that hold dates turned into timestamps; looks at the data right away."""
    found = date_formats(df)
    return parse_dates(df, found) if found else df


def _head(df: DataFrame) -> DataFrame:
    """Everything one aggregation over all columns can tell."""
    parts = []
    for i, c in enumerate(df.columns):
        kind = column_kind(df, c)
        moments = _moments(number_sql(df, c)) if kind == "NUMERIC" else {}
        dates = _moment_parts(c) if kind == "DATE_TIME" else {}
        parts.append(
            {
                "position": str(i),
                "column": literal(c),
                "original_type": literal(df.schema[c].dataType.simpleString()),
                "type": literal(kind),
                "extended_type": literal(extended_kind(df, c)),
                **_counts(df, c),
                "finite_count": moments.get("finite_count", "CAST(NULL AS BIGINT)"),
                **{
                    n: moments.get(n, "CAST(NULL AS DOUBLE)")
                    for n in ("mean", "standard_deviation", "minimum", "maximum")
                },
                **{f"{n}_date": dates.get(n, literal(None)) for n in ("mean", "minimum", "maximum")},
            }
        )
    return per_column(df, parts)


def profile(df: DataFrame, *, detect_dates: bool = True) -> DataFrame:
    """One flat row per column: counts, moments, quartiles, number of bins, most common value.

    Five readings of the table: one aggregation for all columns, three to pin down the quartiles (sketch, counts
    between fences, the wanted slices), one to count texts, after a look at how long they are; long ones are read once
    more for each column. ``detect_dates`` looks for dates in text columns first, with up
    to two more.
    """
    if detect_dates:
        df = with_dates(df)
    out = _head(df)
    numbers = numeric_columns(df)
    if numbers:
        quartiles = quantile_table(df, numbers, QUARTILES).withColumn("histogram_bins", rule_bins("fd"))
        quartiles = quartiles.drop("n", "lo", "hi")
    else:
        quartiles = out.select("column", *[F.lit(None).cast("double").alias(q) for q in QUARTILES]).withColumn(
            "histogram_bins", F.lit(None).cast("bigint")
        )
    texts = _comparable(df, _of_kind(df, "STRING", None))
    if texts:
        common = profile_string(df, texts).drop("counts")
    else:
        common = out.select(
            "column",
            F.lit(None).cast("string").alias("most_common_value"),
            F.lit(None).cast("bigint").alias("most_common_value_count"),
            F.lit(None).cast("bigint").alias("unique_value_count"),
        )
    return out.join(F.broadcast(quartiles), "column", "left").join(common, "column", "left")


def profile_histograms(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, n, q1, q2, q3, index, left_value, right_value, count)`` for numeric columns.

    Quartiles ride along with the bins, so that neither is computed twice.
    """
    names = _of_kind(df, "NUMERIC", columns)
    layout = quantile_table(df, names, QUARTILES).withColumn("bins", rule_bins("fd"))
    return binned(long_numbers(df, names), layout, ("n", "q1", "q2", "q3"))


def profile_documents(df: DataFrame, *, detect_dates: bool = True) -> DataFrame:
    """One nested document per column, with quantiles, value counts and histogram buckets.

    A document holds all buckets of its column, as many as the bin rule asks for; :func:`profile_histograms` gives them as
    rows instead.
    """
    if detect_dates:
        df = with_dates(df)
    out = _head(df)
    bucket_type = (
        "array<struct<index:bigint,label:string,left_value:double,right_value:double,count:bigint>>"
    )
    date_bucket_type = (
        "array<struct<index:bigint,label:string,left_value:string,right_value:string,count:bigint>>"
    )
    numbers, dates = _of_kind(df, "NUMERIC", None), _of_kind(df, "DATE_TIME", None)
    texts = _comparable(df, _of_kind(df, "STRING", None))

    if numbers:
        bucket = F.struct(
            "index",
            F.format_string("%.2f - %.2f", "left_value", "right_value").alias("label"),
            "left_value",
            "right_value",
            "count",
        )
        shaped = profile_histograms(df, numbers).groupBy("column").agg(
            F.sort_array(F.collect_list(bucket)).alias("buckets"),
            F.array(
                *[
                    F.struct(F.lit(p).alias("point"), F.first(q).alias("value"))
                    for q, p in QUARTILES.items()
                ]
            ).alias("quantiles"),
        )
        out = out.join(shaped, "column", "left")  # no hint: bucket lists may be long
    else:
        out = out.withColumn("buckets", F.lit(None).cast(bucket_type)).withColumn(
            "quantiles", F.lit(None).cast("array<struct<point:double,value:double>>")
        )
    if dates:
        bucket = F.struct("index", "label", "left_value", "right_value", "count")
        shaped = datetime_histogram(df, dates).groupBy("column").agg(
            F.sort_array(F.collect_list(bucket)).alias("date_buckets")
        )
        out = out.join(shaped, "column", "left")  # no hint: bucket lists may be long
    else:
        out = out.withColumn("date_buckets", F.lit(None).cast(date_bucket_type))
    if texts:
        out = out.join(profile_string(df, texts), "column", "left")  # no hint: nor are texts bounded
    else:
        out = (
            out.withColumn("most_common_value", F.lit(None).cast("string"))
            .withColumn("most_common_value_count", F.lit(None).cast("bigint"))
            .withColumn("counts", F.lit(None).cast("array<struct<key:string,value:bigint>>"))
            .withColumn("unique_value_count", F.lit(None).cast("bigint"))
        )

    no_buckets, no_date_buckets = F.array().cast(bucket_type), F.array().cast(date_bucket_type)
    numeric = F.struct(
        "finite_count",
        "mean",
        "standard_deviation",
        "minimum",
        "maximum",
        F.coalesce("quantiles", F.array().cast("array<struct<point:double,value:double>>")).alias("quantiles"),
        F.struct(F.coalesce("buckets", no_buckets).alias("buckets")).alias("histogram"),
    )
    text = F.struct(
        "most_common_value",
        F.coalesce("most_common_value_count", F.lit(0)).alias("most_common_value_count"),
        F.coalesce("counts", F.array().cast("array<struct<key:string,value:bigint>>")).alias("counts"),
        F.coalesce("unique_value_count", F.lit(0)).alias("unique_value_count"),
    )
    moment = F.struct(
        F.col("mean_date").alias("mean"),
        F.col("minimum_date").alias("minimum"),
        F.col("maximum_date").alias("maximum"),
        F.struct(F.coalesce("date_buckets", no_date_buckets).alias("buckets")).alias("histogram"),
    )
    return out.select(
        F.lit(fixed.COLUMN_DOCUMENT).alias("type"),
        F.col("column").alias("name"),
        F.lit("").alias("description"),
        F.struct(F.col("position").alias("order"), "original_type", F.col("type"), "extended_type").alias(
            "table_column_info"
        ),
        F.struct(
            "total_count",
            "non_null_count",
            "valid_count",
            F.when(F.col("type") == "NUMERIC", numeric).alias("numeric_metrics"),
            F.when(F.col("type") == "STRING", text).alias("string_metrics"),
            F.when(F.col("type") == "DATE_TIME", moment).alias("date_time_metrics"),
        ).alias("table_column_metrics"),
    )
