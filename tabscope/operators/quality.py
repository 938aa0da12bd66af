"""What is wrong with a table: missing cells, copies and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import fixed
from tabscope.functions.reshape import digest_sql, literal_rows, long_numbers, per_column, text_sql
from tabscope.functions.scalars import (
    Names,
    any_of,
    as_list,
    as_number,
    known,
    known_sql,
    literal,
    measure_columns,
    number_sql,
    order_key,
    quoted,
    ref,
    reject_maps,
    short_sql,
)
from tabscope.operators.quantiles import quantile_table

# Copies of one row that a single task writes out; larger groups are spread over several tasks.
COPIES_PER_TASK = 100_000


def missing_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one missing cell."""
    return df.filter(any_of(known(df, c).isNull() for c in df.columns))


def duplicate_rows(df: DataFrame, subset: Names | None = None, order_by: Names | None = None) -> DataFrame:
    """Second and later copies.

    Copies of a whole row are identical, so they are counted and written out again: a row that
    makes up a third of the table is merged before the shuffle and unfolded by many tasks after it.
    With ``subset``, ``order_by`` says which row of a group is the first one (see :func:`first_rows`).
    """
    if subset is None:
        reject_maps(df, df.columns)
        groups = df.groupBy(*[ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
        return _unfolded(groups.withColumn("_copies", F.col("_copies") - 1), df.columns)
    # Whole rows with their number of copies, less the one row of each group that comes first. Groups are only merged, so
    # their other rows never meet in one task.
    reject_maps(df, df.columns)
    firsts = first_rows(df, subset, order_by)
    rows = df.groupBy(*[ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    # Both sides know a row by 128 bits of hashes, so that long texts are no join keys.
    digest = [F.expr(d).alias(f"_h{i}") for i, d in enumerate(_row_digest(df))]
    one = firsts.select(*digest, F.lit(1).alias("_first"))
    left = rows.select("*", *digest).join(one, ["_h0", "_h1"], "left").select(
        *[ref(c) for c in df.columns], (F.col("_copies") - F.coalesce("_first", F.lit(0))).alias("_copies")
    )
    return _unfolded(left, df.columns)


def _row_digest(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.StructType)
    return digest_sql([text_sql(df, c) if isinstance(df.schema[c].dataType, nested) else quoted(c) for c in df.columns])


def _unfolded(groups: DataFrame, names: list[str]) -> DataFrame:
    """Every row as often as ``_copies`` says, written out by as many tasks as it takes."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES_PER_TASK))
    batches = groups.filter(F.col("_copies") > 0).withColumn("_batch", F.explode(chunks))
    spread = batches.repartition(*[ref(c) for c in names], "_batch")
    size = F.least(F.lit(COPIES_PER_TASK), F.col("_copies") - F.col("_batch") * COPIES_PER_TASK)
    copies = F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("_copy")
    return spread.select(*[ref(c) for c in names], copies).drop("_copy")


def first_rows(df: DataFrame, subset: Names, order_by: Names | None) -> DataFrame:
    """The first row of every group of equal ``subset`` values, in one reading.

    A missing order key comes first; of rows with equal keys the one that sorts first by all its columns does.
    """
    if order_by is None:
        raise ValueError("copies by subset need order_by, the key that says which row comes first")
    reject_maps(df, df.columns)
    keys = [_short(df, c).alias(f"_k{i}") for i, c in enumerate(as_list(subset))]
    whole = F.struct(*[ref(c) for c in df.columns])
    # Inside a struct a missing key is a value like any other.
    first = F.min_by(whole, F.struct(order_key(order_by).alias("at"), whole.alias("row")))
    groups = df.groupBy(*keys).agg(first.alias("_row"))
    return groups.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def _short(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() != "string":
        return ref(name)
    return F.expr(short_sql(quoted(name)))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row with the number of second and later copies of whole rows; equal hashes of 128 bits count as equal rows."""
    reject_maps(df, df.columns)
    groups = df.groupBy(*[F.expr(d).alias(f"_h{i}") for i, d in enumerate(_row_digest(df))]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


# --- outliers -------------------------------------------------------------------------------


def iqr_bounds(df: DataFrame, columns: Names | None = None, fence: float = fixed.IQR_FENCE) -> DataFrame:
    """``(column, q1, q3, lower, upper)``."""
    names = as_list(columns) or measure_columns(df)
    quartiles = quantile_table(df, names, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    lower, upper = (F.col("q1") - fence * spread).alias("lower"), (F.col("q3") + fence * spread).alias("upper")
    return quartiles.select("column", "q1", "q3", lower, upper)


def z_bounds(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, mean, deviation)`` with the population deviation."""
    names = as_list(columns) or measure_columns(df)
    parts = [
        {
            "column": literal(c),
            "mean": f"avg({number_sql(df, c)})",
            "deviation": f"stddev_pop({number_sql(df, c)})",
        }
        for c in names
    ]
    return per_column(df, parts)


def _outside(value: Column, lower: Column, upper: Column) -> Column:
    return (value < lower) | (value > upper)


def _far(value: Column, mean: Column, deviation: Column, limit: float) -> Column:
    """Beyond the limit in standard deviations; a constant column has no such values."""
    return F.coalesce(F.abs(F.try_divide(value - mean, deviation)) > limit, F.lit(False))


def iqr_outliers(df: DataFrame, column: str, fence: float = fixed.IQR_FENCE) -> DataFrame:
    """Rows outside the quartile fences of one column."""
    bounds = iqr_bounds(df, column, fence).agg(F.struct(F.max("lower").alias("lower"), F.max("upper").alias("upper")))
    limits = bounds.scalar()
    return df.filter(_outside(as_number(df, column), limits["lower"], limits["upper"]))


def zscore_outliers(df: DataFrame, column: str, limit: float = fixed.Z_LIMIT) -> DataFrame:
    """Rows more than ``limit`` population deviations from the mean of one column."""
    value = as_number(df, column)
    moments = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))).scalar()
    return df.filter(_far(value, moments["mean"], moments["deviation"], limit))


def outlier_limits(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, lower, upper, mean, deviation)``, one row per numeric column."""
    names = as_list(columns) or measure_columns(df)
    bounds = iqr_bounds(df, names).select("column", "lower", "upper")
    return z_bounds(df, names).join(F.broadcast(bounds), "column", "left")


def is_outlier(value: Column, limits: Column | None = None, z_limit: float = fixed.Z_LIMIT) -> Column:
    """Whether either method flags a value; limits come from columns or from a struct."""

    def limit(name: str) -> Column:
        return F.col(name) if limits is None else limits[name]

    fences = F.coalesce(_outside(value, limit("lower"), limit("upper")), F.lit(False))
    return fences | _far(value, limit("mean"), limit("deviation"), z_limit)


def outlier_values(df: DataFrame, columns: Names | None = None, *, skip_nullable: bool = False) -> DataFrame:
    """``(column, value)``: distinct values that either method flags, for every numeric column.

    ``skip_nullable`` leaves out columns with any missing value.
    """
    names = as_list(columns) or measure_columns(df)
    limits = outlier_limits(df, names)
    if skip_nullable:
        whole = [{"column": literal(c), "gaps": f"count(*) - count({known_sql(df, c)})"} for c in names]
        limits = limits.join(F.broadcast(per_column(df, whole).filter("gaps = 0")), "column", "left_semi")
    numbers = long_numbers(df, names)
    flagged = numbers.join(F.broadcast(limits), "column").filter(is_outlier(F.col("value")))
    return flagged.select("column", "value").distinct()


# --- report ---------------------------------------------------------------------------------


def quality_counts(df: DataFrame) -> DataFrame:
    """``(measure, column, total)``: missing rows, copies and distinct outliers per column."""
    incomplete = any_of(known(df, c).isNull() for c in df.columns)
    missing = df.agg(F.count_if(incomplete).alias("total")).select(
        F.lit("missing_rows").alias("measure"), F.lit("").alias("column"), "total"
    )
    copies = duplicate_count(df).select(
        F.lit("duplicate_rows").alias("measure"), F.lit("").alias("column"), F.col("duplicates").alias("total")
    )
    report = missing.unionByName(copies)
    names = measure_columns(df)
    if names:
        # Columns without outliers are listed with zero.
        listed = literal_rows(df.sparkSession, [{"column": c} for c in names])
        found = outlier_values(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("found"))
        outliers = listed.join(F.broadcast(found), "column", "left").select(
            F.lit("outliers").alias("measure"), "column", F.coalesce("found", F.lit(0)).alias("total")
        )
        report = report.unionByName(outliers)
    return report


def column_types(df: DataFrame) -> DataFrame:
    """``(column, data_type)`` from the schema alone."""
    return literal_rows(df.sparkSession, [{"column": c, "data_type": t} for c, t in df.dtypes])


def quality_report(df: DataFrame) -> DataFrame:
    """``(measure, column, value)``: the counts and the column types as text."""
    counts = quality_counts(df).select("measure", "column", F.col("total").cast("string").alias("value"))
    types = column_types(df).select(F.lit("data_type").alias("measure"), "column", F.col("data_type").alias("value"))
    return counts.unionByName(types)
