"""Listing, searching and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.functions import fixed
from tabscope.functions.scalars import (
    Names,
    as_list,
    field_type,
    is_floating,
    order_columns,
    order_key,
    ref,
)
from tabscope.operators.ranges import NARROW, rows_between


def active(df: DataFrame) -> DataFrame:
    """Records that are not deleted; a missing flag means not deleted."""
    if "deleted_at" in df.columns:
        df = df.filter(F.col("deleted_at").isNull())
    if "is_deleted" in df.columns:
        df = df.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    return df


def contains_text(column: Column, part: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(column), F.lower(F.lit(part)))


def search_files(files: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Live files that are no samples, by part of the name and by type, newest first."""
    found = active(files)
    if "is_sample" in files.columns:
        found = found.filter(~F.coalesce(F.col("is_sample"), F.lit(False)))
    if name:
        found = found.filter(contains_text(F.col("file"), name))
    if kind:
        found = found.filter(F.col("type") == kind)
    return found.orderBy(F.col("created_at").desc())


def search_text(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text contains the part, in any case."""
    field_type(df, column)
    return df.filter(contains_text(ref(column), part))


def files_of_project(files: DataFrame, project_id: str) -> DataFrame:
    return files.filter(F.col("project_id") == project_id)


def files_of_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files whose project is among the given ones."""
    keys = projects.select(F.col("_id").alias("project_id"))
    return files.join(keys, "project_id", "left_semi")


def list_sorted(df: DataFrame, sort_by: str) -> DataFrame:
    """Sorted by one column; a leading minus sorts downwards."""
    field_type(df, sort_by.removeprefix("-"))
    return df.orderBy(*order_columns(sort_by))


def head_rows(df: DataFrame, n: int, order_by: Names) -> DataFrame:
    """The first rows; zero means all of them."""
    if n < 0:
        raise ValueError("n must not be negative")
    ordered = df.orderBy(*order_columns(order_by))
    return ordered.limit(n) if n else ordered


def floats_as_text(df: DataFrame) -> DataFrame:
    """Floating columns as text, the way rows are shown."""
    return df.select(
        *[ref(f.name).cast("string").alias(f.name) if is_floating(f.dataType) else ref(f.name) for f in df.schema]
    )


def page_slice(
    df: DataFrame,
    order_by: Names,
    page: int = 1,
    size: int = fixed.PAGE_SIZE,
    *,
    max_size: int | None = fixed.MAX_PAGE_SIZE,
    narrow: int = NARROW,
) -> DataFrame:
    """One page of the sorted table; a page larger than ``max_size`` is refused.

    Pages within the first ``narrow`` rows are lazy. For deeper ones the range of keys that holds the page is looked up
    right away and only its rows are sorted (see :func:`rows_between`); nothing is written. To turn many pages, go on with
    ``page_after``, or keep an index with ``write_page_index``.
    """
    page, size = _checked(page, size, max_size)
    return rows_between(df, order_by, (page - 1) * size, size, narrow=narrow)


def page_after(df: DataFrame, order_by: Names, last: dict[str, object] | None, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """The rows that follow the last row of the page before, at equal cost for every depth."""
    names = as_list(order_by)
    _, size = _checked(1, size)
    if last is not None:
        beyond = F.lit(False)
        for i, name in enumerate(names):
            equal = F.lit(True)
            for earlier in names[:i]:
                equal = equal & (ref(earlier) == F.lit(last[earlier]))
            beyond = beyond | (equal & (ref(name) > F.lit(last[name])))
        # The first key alone bounds the scan and reaches the file reader.
        df = df.filter((ref(names[0]) >= F.lit(last[names[0]])) & beyond)
    return df.orderBy(*order_columns(names)).limit(size)


def page_info(df: DataFrame, page: int = 1, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """``(count, total_pages, page, size, next, previous)``, one row."""
    page, size = _checked(page, size)
    pages = F.ceil(F.col("count") / size)
    return df.agg(F.count(F.lit(1)).alias("count")).select(
        "count",
        pages.alias("total_pages"),
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        (F.lit(page) < pages).alias("next"),
        F.lit(page > 1).alias("previous"),
    )


def page_list(df: DataFrame, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """``(page)``: the numbers of all pages; an empty table has one empty page."""
    _, size = _checked(1, size)
    last = F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1))
    per_block = 1_000_000
    blocks = df.agg(last.alias("last")).select(
        "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") - 1) / per_block))).alias("b")
    )
    start = F.col("b") * per_block + 1
    return blocks.select(
        F.explode(F.sequence(start, F.least(start + per_block - 1, F.col("last")))).alias("page")
    )


def write_page_index(df: DataFrame, order_by: Names, path: str) -> None:
    """Writes the sorted table with its row numbers, so that any page is a short range read.

    The rows are cut into sorted ranges, numbered within each range by the writing tasks, and
    stored; the sizes of the stored ranges then give every range its first row number.
    """
    numbered = (
        df.orderBy(*order_columns(order_by))
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftrightunsigned("_id", 33))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    numbered.write.mode("errorifexists").partitionBy("_range").parquet(f"{path}/rows")
    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/rows")
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("size"))
    # One row per written range: as many as there were sorting tasks.
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), "size")
    starts.withColumn("_range", F.col("_range").cast("bigint")).write.mode("errorifexists").parquet(f"{path}/ranges")


def read_page(spark: SparkSession, path: str, page: int = 1, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """A page from a page index, with its ``row_number``; filters on range and row reach the files."""
    page, size = _checked(page, size)
    first, end = (page - 1) * size, page * size
    ranges = spark.read.parquet(f"{path}/ranges").filter(
        (F.col("start") < end) & (F.col("start") + F.col("size") > first)
    )
    rows = spark.read.parquet(f"{path}/rows").withColumn("_range", F.col("_range").cast("bigint"))
    at = F.col("start") + F.col("_row")
    return (
        rows.join(F.broadcast(ranges), "_range")  # ranges that touch the page
        .filter((F.col("_row") < end) & (at >= first) & (at < end))
        .withColumn("row_number", at + 1)
        .drop("_range", "_row", "start", "size")
    )


def latest_per_key(df: DataFrame, key: Names, newest_by: Names) -> DataFrame:
    """The newest record of every key; merged inside each task before the shuffle."""
    keys = as_list(key)
    whole = F.struct(*[ref(c) for c in df.columns])
    newest = df.groupBy(*[ref(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(whole, order_key(newest_by)).alias("_row")
    )
    return newest.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def find_record(files: DataFrame, project_id: str, identifier: str) -> DataFrame:
    """A live file by id, else by name, else the newest one of the project."""
    rank = (
        F.when(F.col("_id") == identifier, 0)
        .when(F.col("filename") == identifier, 1)
        .when(F.col("project_id") == project_id, 2)
    )
    found = active(files).withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    return found.orderBy("_rank", F.col("created_at").desc()).limit(1).drop("_rank")


def _checked(page: int, size: int, max_size: int | None = None) -> tuple[int, int]:
    if page < 1:
        raise ValueError("pages are numbered from 1")
    if size < 1:
        raise ValueError("a page holds at least one row")
    if max_size is not None and size > max_size:
        raise ValueError(f"a page holds at most {max_size} rows")
    return page, size
