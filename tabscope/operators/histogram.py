"""Equal-width histograms and the rules that choose their number of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions import fixed
from tabscope.functions.reshape import long_numbers, per_column
from tabscope.functions.scalars import Names, as_list, epoch_seconds, iso_text, literal, number_sql, ref
from tabscope.operators.quantiles import quantile_table


def edge_sql(i: str) -> str:
    """Left edge of bin ``i`` from ``lo, hi, bins``; edge ``bins`` is the upper limit itself."""
    return f"IF({i} >= bins, hi, ({i}) * ((hi - lo) / bins) + lo)"


def bucket_sql(guess: str) -> str:
    """Bin of ``value`` when the last bin is closed, from a guess one bin off at most.

    The quotient alone lands one bin off where rounding disagrees with the edges, so the guess is
    moved to the bin whose edges enclose the value.
    """
    return (
        f"CASE WHEN value < {edge_sql(guess)} THEN {guess} - 1 "
        f"WHEN {guess} < bins - 1 AND value >= {edge_sql(f'{guess} + 1')} THEN {guess} + 1 "
        f"ELSE {guess} END"
    )


def equal_width_bucket(value: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """The same for any columns."""
    at = F.struct(value.alias("value"), lo.alias("lo"), hi.alias("hi"), bins.cast("bigint").alias("bins"))

    def edge(i: Column, a: Column) -> Column:
        return F.when(i >= a["bins"], a["hi"]).otherwise(i * ((a["hi"] - a["lo"]) / a["bins"]) + a["lo"])

    guess = F.least(F.floor((at["value"] - at["lo"]) * at["bins"] / (at["hi"] - at["lo"])), at["bins"] - 1)
    return (
        F.when(at["value"] < edge(guess, at), guess - 1)
        .when((guess < at["bins"] - 1) & (at["value"] >= edge(guess + 1, at)), guess + 1)
        .otherwise(guess)
    )


def bin_count(df: DataFrame, columns: Names, method: str = "fd") -> DataFrame:
    """``(column, n, lo, hi, bins)``: number of bins a rule chooses; unknown rules mean ``fd``."""
    return _layout(df, as_list(columns), method).select("column", "n", "lo", "hi", "bins")


def histogram(
    df: DataFrame, columns: Names, method: str = "fd", *, strip: bool = False, filled_only: bool = False
) -> DataFrame:
    """``(column, index, label, left_value, right_value, count)``, empty bins included.

    ``filled_only`` leaves them out: a single far value can make a rule ask for more bins than there are rows.
    """
    names = as_list(columns)
    layout = _layout(df, names, method, strip=strip)
    return _labelled(binned(long_numbers(df, names, strip=strip), layout, filled_only=filled_only))


def fixed_histogram(df: DataFrame, columns: Names, bins: int, *, strip: bool = False) -> DataFrame:
    """Histogram with a given number of bins."""
    if bins < 1:
        raise ValueError("a histogram needs at least one bin")
    names = as_list(columns)
    parts = []
    for c in names:
        value = number_sql(df, c, strip=strip)
        ends = {"lo": f"min({value})", "hi": f"max({value})"}
        parts.append({"column": literal(c), **ends, "bins": f"CAST({bins} AS BIGINT)"})
    return _labelled(binned(long_numbers(df, names, strip=strip), per_column(df, parts)))


def datetime_histogram(df: DataFrame, columns: Names, bins: int = fixed.DATETIME_BINS) -> DataFrame:
    """Histogram over whole epoch seconds, with ISO edges."""
    names = as_list(columns)
    seconds = df.select(*[epoch_seconds(ref(c)).alias(c) for c in names])
    counted = fixed_histogram(seconds, names, bins)

    def moment(edge: str) -> Column:
        return F.timestamp_micros(F.round(F.col(edge) * 1_000_000).cast("bigint"))

    left, right = moment("left_value"), moment("right_value")
    return counted.select(
        "column",
        "index",
        F.concat_ws(" - ", F.date_format(left, "yyyy-MM-dd"), F.date_format(right, "yyyy-MM-dd")).alias("label"),
        iso_text(left).alias("left_value"),
        iso_text(right).alias("right_value"),
        "count",
    )


def binned(
    numbers: DataFrame, layout: DataFrame, carry: tuple[str, ...] = (), *, filled_only: bool = False
) -> DataFrame:
    """Counts per bin of ``(column, value)`` rows; ``layout`` has one row per column.

    Empty bins are listed with zero, a column's many bins by many tasks; ``filled_only`` leaves them out.
    """
    widened = layout.selectExpr(
        "column", "bins", "IF(lo = hi, lo - 0.5, lo) AS lo", "IF(lo = hi, hi + 0.5, hi) AS hi", *carry
    )
    facts = ("bins", "lo", "hi", *carry)
    counted = (
        numbers.join(F.broadcast(widened), "column")  # one row per column of the table
        .selectExpr("*", f"{_GUESS} AS guess")
        .selectExpr("column", f"{bucket_sql('guess')} AS index", *facts)
        .groupBy("column", "index")
        .agg(F.expr("count(*) AS count"), *[F.expr(f"first({c}) AS {c}") for c in facts])
    )
    edges = (f"{edge_sql('index')} AS left_value", f"{edge_sql('index + 1')} AS right_value")
    if filled_only:
        return counted.selectExpr("column", "index", *edges, "count", *carry)
    # All bins are listed block by block, blocks by many tasks, and meet their counts by column and bin.
    listed = widened.filter("lo IS NOT NULL").selectExpr("*", f"explode(sequence(0L, (bins - 1) div {_BLOCK})) AS block").repartition("column", "block")
    block = f"sequence(block * {_BLOCK}, least(block * {_BLOCK} + {_BLOCK - 1}, bins - 1))"
    slots = listed.selectExpr("column", f"explode({block}) AS index", *facts)
    found = counted.select("column", "index", "count")
    return slots.join(found, ["column", "index"], "left").selectExpr("column", "index", *edges, "coalesce(count, 0L) AS count", *carry)


#: Bins that one array lists.
_BLOCK = 100_000
_GUESS = "least(floor((value - lo) * bins / (hi - lo)), bins - 1)"


def _labelled(bins: DataFrame) -> DataFrame:
    return bins.select(
        "column",
        "index",
        F.format_string("%.2f - %.2f", "left_value", "right_value").alias("label"),
        "left_value",
        "right_value",
        "count",
    )


def _layout(df: DataFrame, columns: list[str], method: str, *, strip: bool = False) -> DataFrame:
    """``(column, n, lo, hi, bins)`` for columns that hold a value."""
    if method in ("sturges", "rice", "sqrt", "doane", "scott", "custom"):
        shape = {"doane": "skewness", "scott": "stddev_pop"}.get(method)
        parts = []
        for c in columns:
            value = number_sql(df, c, strip=strip)
            part = {"column": literal(c), "n": f"count({value})", "lo": f"min({value})", "hi": f"max({value})"}
            if shape:
                part["shape"] = f"{shape}({value})"
            parts.append(part)
        found = per_column(df, parts).filter("n > 0")
    else:
        found = quantile_table(df, columns, {"q1": 0.25, "q3": 0.75}, strip=strip)
    return found.withColumn("bins", rule_bins(method))


def rule_bins(method: str) -> Column:
    """Bins from a row of ``n, lo, hi`` and, by rule, ``q1, q3`` or ``shape``."""
    by_width = "ceil((hi - lo) / IF({width} = 0, 1D, {width}))"
    n = "CAST(n AS DOUBLE)"
    skew = f"try_divide(sqrt({n} * ({n} - 1)) * coalesce(nanvl(shape, 0D), 0D), {n} - 2)"
    spread = f"sqrt(6 * ({n} - 2) / (({n} + 1) * ({n} + 3)))"
    rules = {
        "sturges": f"ceil(log2({n}) + 1)",
        "rice": f"ceil(2 * cbrt({n}))",
        "sqrt": f"ceil(sqrt({n}))",
        "doane": f"floor(1 + log2({n}) + log2(1 + try_divide(abs({skew}), {spread})))",
        "scott": by_width.format(width=f"(3.5D * shape / cbrt({n}))"),
        "custom": str(fixed.CUSTOM_BINS),
    }
    chosen = rules.get(method, by_width.format(width=f"(2 * (q3 - q1) / cbrt({n}))"))
    return F.expr(f"greatest(coalesce(CAST({chosen} AS BIGINT), 1L), 1L)")
