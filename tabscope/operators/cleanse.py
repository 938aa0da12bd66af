"""Repairing a table: dropping, imputing and converting."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import fixed
from tabscope.functions.reshape import SLOTS, as_text, long_typed, slot_of
from tabscope.functions.scalars import (
    Names,
    any_of,
    as_list,
    as_number,
    coerce_numeric,
    field_type,
    is_moment,
    known,
    measure_columns,
    ref,
    reject_maps,
)
from tabscope.operators.quality import first_rows, is_outlier, outlier_limits
from tabscope.sources.shared import computed_once


def drop_missing(df: DataFrame, subset: Names) -> DataFrame:
    """Rows complete in the given columns."""
    return df.filter(~any_of(known(df, c).isNull() for c in as_list(subset)))


def delete_missing_row(df: DataFrame) -> DataFrame:
    """Complete rows only."""
    return drop_missing(df, df.columns)


def delete_duplicate_row(df: DataFrame, subset: Names | None = None, order_by: Names | None = None) -> DataFrame:
    """One copy of every row; by ``subset``, the first row in ``order_by``."""
    if subset is None:
        reject_maps(df, df.columns)
        return df.dropDuplicates()
    return first_rows(df, subset, order_by)


def delete_row_outlier(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """Rows without an outlier in any numeric column."""
    names = as_list(columns) or measure_columns(df)
    if not names:
        return df
    fields = ("lower", "upper", "mean", "deviation")
    # One struct per column, all in one row.
    limits = outlier_limits(df, names)
    row = limits.agg(
        F.struct(
            *[
                F.struct(
                    *[F.max(F.when(F.col("column") == c, F.col(f))).alias(f) for f in fields],
                ).alias(f"c{i}")
                for i, c in enumerate(names)
            ]
        )
    ).scalar()
    flagged = [is_outlier(as_number(df, c), row[f"c{i}"]) for i, c in enumerate(names)]
    return df.filter(~F.coalesce(any_of(flagged), F.lit(False)))


def impute_by_mean(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """Missing numbers replaced by the mean of their column; whole-number columns become double."""
    names = as_list(columns) or measure_columns(df)
    if not names:
        return df
    means = df.agg(F.struct(*[F.avg(as_number(df, c)).alias(f"c{i}") for i, c in enumerate(names)])).scalar()
    at = {c: i for i, c in enumerate(names)}
    return df.select(
        *[
            F.coalesce(as_number(df, c), means[f"c{at[c]}"]).alias(c) if c in at else ref(c)
            for c in df.columns
        ]
    )


def column_modes(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """``(column, n, whole, number, moment, text)``: most frequent value, the lowest on a tie."""
    names = as_list(columns) or df.columns
    found = []
    for slot, values in long_typed(df, names).items():
        counted = values.groupBy("column", "value").agg(F.expr("-count(*) AS less"))
        best = counted.groupBy("column").agg(F.expr("min(struct(less, value)) AS best"))
        slots = [f"{'best.value' if s == slot else f'CAST(NULL AS {t})'} AS {s}" for s, t in SLOTS.items()]
        found.append(best.selectExpr("column", "-best.less AS n", *slots))
    return reduce(DataFrame.unionByName, found)


def impute_by_mode(df: DataFrame, columns: Names | None = None) -> DataFrame:
    """Missing cells replaced by the most frequent value of their column."""
    names = as_list(columns) or [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    slots = {c: slot_of(field_type(df, c)) for c in names}
    modes = column_modes(df, names)
    row = modes.agg(
        F.struct(
            *[F.max(F.when(F.col("column") == c, F.col(slots[c]))).alias(f"c{i}") for i, c in enumerate(names)]
        )
    ).scalar()
    at = {c: i for i, c in enumerate(names)}
    return df.select(
        *[
            F.coalesce(known(df, c), row[f"c{at[c]}"].cast(field_type(df, c))).alias(c) if c in at else ref(c)
            for c in df.columns
        ]
    )


def convert_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns cast to the named types; what cannot be read becomes missing."""
    for name in mapping:
        field_type(df, name)
    return df.select(
        *[_convert(df, c, mapping[c]).alias(c) if c in mapping else ref(c) for c in df.columns]
    )


def _convert(df: DataFrame, name: str, target: str) -> Column:
    source = field_type(df, name)
    wanted = T._parse_datatype_string(target)
    column = ref(name)
    if isinstance(source, T.StringType) and isinstance(wanted, T.NumericType):
        readable = F.when(coerce_numeric(column).isNotNull(), F.trim(column))
        return readable.try_cast(wanted)
    if is_moment(source) and isinstance(wanted, T.NumericType):
        return F.unix_micros(column.cast("timestamp")).try_cast(wanted)
    return column.try_cast(wanted)


def remove_missing_cell(df: DataFrame, keys: Names) -> DataFrame:
    """``(<keys>, column, value)``: one row per cell that is not missing, values as text."""
    names = as_list(keys)
    rest = [c for c in df.columns if c not in names]
    if len(rest) < 1:
        raise ValueError("no columns besides the keys")
    cells = [F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in rest]
    return df.select(*[ref(c) for c in names], F.inline(F.array(*cells))).filter(F.col("value").isNotNull())


_STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "delete_missing_row": delete_missing_row,
    "delete_duplicate_row": delete_duplicate_row,
    "delete_row_outlier": delete_row_outlier,
    "impute_by_mean": impute_by_mean,
    "impute_by_mode": impute_by_mode,
}

#: Steps that look something up in the whole table before they change it.
_SEVERAL_READINGS = ("delete_row_outlier", "impute_by_mean", "impute_by_mode")


def cleanse(
    df: DataFrame,
    steps: Iterable[str],
    *,
    types: dict[str, str] | None = None,
    keys: Names | None = None,
) -> DataFrame:
    """Named steps, always in the order of ``CLEANSING_STEPS``.

    ``data_type_conversion`` takes its target types from ``types``; ``remove_missing_cell`` keeps
    ``keys`` beside each cell. Steps after ``delete_duplicate_row`` that read the table several times read a stored one.
    """
    wanted = set(steps)
    unknown = wanted - set(fixed.CLEANSING_STEPS)
    if unknown:
        raise ValueError(f"Unknown cleansing steps: {', '.join(sorted(unknown))}")
    merged = False
    for step in fixed.CLEANSING_STEPS:
        if step not in wanted:
            continue
        if step in _SEVERAL_READINGS and merged:
            # Copies are merged once, not again in every reading.
            df, merged = computed_once(df, "cleansed"), False
        merged |= step == "delete_duplicate_row"
        if step == "data_type_conversion":
            df = convert_types(df, types or {})
        elif step == "remove_missing_cell":
            df = remove_missing_cell(df, keys or [])
        else:
            df = _STEPS[step](df)
    return df
