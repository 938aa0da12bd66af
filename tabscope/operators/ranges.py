"""Places and running sums in a sorted table without sorting it in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.scalars import Names, all_of, any_of, as_list, field_type, order_columns, ref
from tabscope.sources.shared import fresh_path

# Rows that a task keeps at most to sort out one page.
NARROW = 1_000_000
# Keys that are looked at to narrow a range down.
SAMPLE = 20_000
# Types whose values can stand in a filter.
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _before(df: DataFrame, names: Sequence[str], key: Sequence[object]) -> Column:
    """Whether a row comes before ``key`` in the order of ``names``: missing values first, or last where turned around."""
    cases, equal = [], []
    for name, value in zip(names, key, strict=True):
        turned, column = name.startswith("-"), ref(name.removeprefix("-"))
        fixed = F.lit(value).cast(df.schema[name.removeprefix("-")].dataType)
        if value is None:
            first = column.isNotNull() if turned else F.lit(False)
        else:
            first = column > fixed if turned else column.isNull() | (column < fixed)
        cases.append(all_of([*equal, F.coalesce(first, F.lit(False))]))
        equal.append(column.eqNullSafe(fixed))
    return any_of(cases)


def _same(df: DataFrame, names: Sequence[str], key: Sequence[object]) -> Column:
    bare = [n.removeprefix("-") for n in names]
    return all_of(ref(n).eqNullSafe(F.lit(v).cast(df.schema[n].dataType)) for n, v in zip(bare, key, strict=True))


def _leading(df: DataFrame, name: str, low: object, high: object) -> Column:
    """What the first key alone says about a range; it reaches the file reader."""
    bare = name.removeprefix("-")
    column, kind = ref(bare), df.schema[bare].dataType
    if name.startswith("-"):
        low, high = high, low
    parts = [column >= F.lit(low).cast(kind)] if low is not None else []
    parts += [column <= F.lit(high).cast(kind)] if high is not None else []
    return all_of(parts) | column.isNull()


def rows_between(df: DataFrame, order_by: Names, first: int, size: int, *, narrow: int = NARROW) -> DataFrame:
    """Rows ``first .. first + size - 1`` of the table in the order of ``order_by``, counted from zero.

    Tasks keep at most about ``narrow`` rows beyond the wanted ones. Where more rows come before the wanted ones, the range
    of keys that holds them is narrowed down first: a sample of the keys names two of them, a count of the rows before and
    between them checks that, until few rows are left. That runs right away; only rows of the last range are sorted. Rows
    with equal keys are in no particular order, so keys should tell rows apart.
    """
    names = as_list(order_by)
    bare = [n.removeprefix("-") for n in names]
    ordered = order_columns(names)
    plain = all(isinstance(field_type(df, n), _PLAIN) for n in bare)
    inside, before = df, 0
    if first + size > narrow and plain:
        total = count = df.count()
        if first >= total:
            return df.limit(0)
        last, spread = min(first + size, total), 1.0
        while last - before > narrow and count > narrow:
            keys = inside.select(*[ref(n) for n in bare]).sample(min(1.0, SAMPLE / count), seed=7).orderBy(*ordered).collect()
            keys = [tuple(k) for k in keys]
            if not keys:
                break
            # The sample misses a share by three of its standard deviations at most, as a rule.
            margin = spread * 1.5 / math.sqrt(len(keys))
            low = math.floor(len(keys) * ((first - before) / count - margin))
            high = math.ceil(len(keys) * ((last - before) / count + margin))
            low, high = keys[max(low, 0)] if low > 0 else None, keys[high] if high < len(keys) else None
            too_low = _before(df, names, low) if low else F.lit(False)
            not_high = (_before(df, names, high) | _same(df, names, high)) if high else F.lit(True)
            counts = inside.agg(F.count_if(too_low).alias("low"), F.count_if(~too_low & not_high).alias("between")).first()
            if not before + counts["low"] <= first <= last <= before + counts["low"] + counts["between"]:
                spread *= 2  # an unlucky sample
                continue
            if counts["between"] == count:
                break  # equal keys
            inside = inside.filter(~too_low & not_high)
            if low and high:
                inside = inside.filter(_leading(df, names[0], low[0], high[0]))
            before, count, spread = before + counts["low"], counts["between"], 1.0
    return inside.orderBy(*ordered).offset(first - before).limit(size)


def running_sums(df: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """``df`` with ``position`` (from 1), ``end`` (the sum of ``value`` up to the row, in ``order``) and ``size`` (all rows).

    Sorted ranges are written to the shared folder; their sums, one row for each sorting task, say where each range goes on.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "running-sums")
    place = F.monotonically_increasing_id()
    df.orderBy(*order).withColumn("_place", place).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_range", F.shiftrightunsigned("_place", 33))
    ranges = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    # As many rows as tasks that sorted.
    rows, passed, total = [], 0, 0.0
    for r in sorted(ranges.collect()):
        rows.append((r["_range"], passed, total))
        passed, total = passed + r["n"], total + (r["total"] or 0)
    begins = spark.createDataFrame(rows, "_range bigint, _passed bigint, _sum double")
    within = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        stored.join(F.broadcast(begins), "_range")
        .withColumns(
            {
                "position": (F.col("_passed") + F.row_number().over(Window.partitionBy("_range").orderBy("_place"))),
                "end": F.col("_sum") + F.coalesce(F.sum(value).over(within), F.lit(0.0)),
                "size": F.lit(passed).cast("bigint"),
            }
        )
        .drop("_range", "_passed", "_sum", "_place")
    )
