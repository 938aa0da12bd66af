"""Exact quantiles of many columns without gathering a column in one place.

``percentile`` keeps every distinct value of a column in one task. Here every wanted rank is narrowed down to a bracket of
values instead: a sketch of each column names two values that the rank lies between, a count of the rows below, inside and
above all brackets checks that, and brackets that still hold many rows are sketched and counted again. Only the values
inside the last brackets are read once more and ranked. A sketch decides how narrow a bracket gets, never the result.

Brackets are a few numbers for each column and point; they are looked up right away, by two small jobs or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.reshape import per_column
from tabscope.functions.scalars import as_number, literal, number_sql

SKETCH_SIZE = 4_000
# Ranks between which a sketch of that size finds a rank, as a share of all; about three times its error.
MARGIN = 0.002
# Rows of a bracket that are ranked in one place; a bracket of one value may hold any number.
NARROW = 1_000_000
# Tasks that merge sketches in the first step.
MERGED = 256


@dataclass
class _Bracket:
    """Values from ``low`` to ``high`` of a column: ``count`` rows, after ``before`` smaller ones, with the wanted ranks."""

    low: float
    high: float
    before: int = 0
    count: int = 0
    # (point, whether it is the upper neighbour, rank, share of the upper neighbour)
    ranks: list[tuple[float, bool, int, float]] = field(default_factory=list)


@dataclass
class _Column:
    n: int
    lowest: float
    highest: float
    brackets: list[_Bracket]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], points: Sequence[float], *, strip: bool = False
) -> DataFrame:
    """``(column, n, lo, hi, point, value)``, interpolated linearly between neighbouring ranks.

    ``n``, ``lo`` and ``hi`` are the count and the extremes of the column's finite values; columns without any have no
    row. The table should not change before the result is read.
    """
    if any(not 0 <= p <= 1 for p in points):
        raise ValueError("quantile points lie between 0 and 1")
    if not columns:
        raise ValueError("no numeric column to work on")
    points = list(dict.fromkeys(float(p) for p in points))
    values = df.select(*[as_number(df, c, strip=strip).alias(f"v{i}") for i, c in enumerate(columns)])
    found = _located(values, _sketched(values, len(columns), points), points)
    # One row per column and wanted rank, so broadcasts have a fixed bound.
    known, wanted, cuts = [], [], []
    for i, column in enumerate(found):
        cuts.append([])
        for b in column.brackets if column else ():
            row = {"n": column.n, "lowest": column.lowest, "highest": column.highest}
            if b.low != b.high:
                cuts[i].append((b.low, b.high))
            for point, upper, rank, part in b.ranks:
                here = {"column": columns[i], **row, "point": point, "upper": upper, "part": part}
                if b.low == b.high:
                    known.append({**here, "value": b.low})
                else:
                    wanted.append({**here, "slice": _number(cuts, i) - 1, "rank": rank - b.before})
    spark = df.sparkSession
    hits = _rows(spark, known, "value")
    if wanted:
        inside = _sliced(values, cuts, between=False).groupBy("slice", "value").agg(F.expr("count(*) AS cnt"))
        # At most NARROW rows of a bracket, with as many values or fewer, reach this window.
        upto = "sum(cnt) OVER (PARTITION BY slice ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto"
        ranked = inside.selectExpr("slice AS at", "value", "cnt", upto)
        place = "at = slice AND rank < upto AND rank >= upto - cnt"
        picked = ranked.join(F.broadcast(_rows(spark, wanted, "slice", "rank")), F.expr(place))
        hits = hits.unionByName(picked.select(hits.columns))
    ends = hits.groupBy("column", "point").agg(
        F.expr("max(IF(upper, NULL, value)) AS a"),
        F.expr("max(IF(upper, value, NULL)) AS b"),
        F.expr("max(part) AS t"),
        *[F.expr(f"first({c}) AS {c}") for c in ("n", "lowest", "highest")],
    )
    # Linear interpolation, taken from the nearer end.
    between = "IF(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t)) AS value"
    return ends.selectExpr("column", "n", "lowest AS lo", "highest AS hi", "point", between)


_KINDS = {"column": "string", "n": "bigint", "lowest": "double", "highest": "double", "point": "double", "upper": "boolean"}
_KINDS |= {"part": "double", "value": "double", "slice": "int", "rank": "bigint"}


def _rows(spark: SparkSession, rows: list[dict[str, object]], *more: str) -> DataFrame:
    """A table of known rows, written as constants: one call whatever their number."""
    names = ["column", "n", "lowest", "highest", "point", "upper", "part", *more]
    kinds = ", ".join(f"CAST({c} AS {_KINDS[c]}) AS {c}" for c in names)
    values = ", ".join(f"({', '.join(_constant(row[c]) for c in names)})" for row in rows)
    if not rows:
        return spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {_KINDS[c]}) AS {c}' for c in names)} WHERE false")
    return spark.sql(f"SELECT {kinds} FROM VALUES {values} AS t({', '.join(names)})")


def _constant(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    return literal(value) if isinstance(value, str) else f"{value}L"


def quantile_table(
    df: DataFrame, columns: Sequence[str], points: dict[str, float], *, strip: bool = False
) -> DataFrame:
    """``(column, n, lo, hi, <name>...)``: one row per column that holds a value."""
    found = exact_quantiles(df, columns, list(points.values()), strip=strip)
    picks = [f"max(IF(point = {float(p)}D, value, NULL)) AS {name}" for name, p in points.items()]
    carried = [f"max({c}) AS {c}" for c in ("n", "lo", "hi")]
    return found.groupBy("column").agg(*[F.expr(e) for e in (*carried, *picks)])


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], points: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """``(column, n, point, value)`` in one pass, with a rank error of ``1 / accuracy``."""
    grid = f"array({', '.join(f'{float(p)}D' for p in points)})"
    parts = []
    for c in columns:
        value = number_sql(df, c)
        values = f"percentile_approx({value}, {grid}, {accuracy})"
        parts.append({"column": literal(c), "n": f"count({value})", "values": values})
    pairs = f"inline(zip_with({grid}, values, (p, v) -> named_struct('point', p, 'value', v)))"
    return per_column(df, parts).filter("n > 0").selectExpr("column", "n", pairs)


# --- brackets -------------------------------------------------------------------------------


def _margins(points: Sequence[float]) -> list[tuple[float, float]]:
    """Ranges of ranks, as shares, around the points; ranges that touch are one."""
    out: list[tuple[float, float]] = []
    for p in sorted(points):
        low, high = max(p - MARGIN, 0.0), min(p + MARGIN, 1.0)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _grid(shares: Sequence[tuple[float, float]]) -> str:
    return f"array({', '.join(f'{x!r}D' for pair in shares for x in pair)})"


def _joined(values: Sequence[float]) -> list[tuple[float, float]]:
    """Pairs of ends in ascending order; those that overlap are one."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(zip(values[::2], values[1::2], strict=True)):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _sketched(values: DataFrame, width: int, points: Sequence[float]) -> list[list[tuple[float, float]]]:
    """For each column the ends of its brackets, from one sketch of all its rows; none for a column without values."""
    shares = _margins(points)
    sketches = [F.expr(f"kll_sketch_agg_double(v{i}, {SKETCH_SIZE})").alias(f"s{i}") for i in range(width)]
    counts = [F.expr(f"count(v{i})").alias(f"n{i}") for i in range(width)]
    # Sketches of all tasks are merged in two steps, so that no task merges more than a share of them.
    parts = values.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("_part")).agg(*sketches, *counts)
    ends = []
    for i in range(width):
        merged = f"kll_merge_agg_double(s{i}, {SKETCH_SIZE}) FILTER (WHERE n{i} > 0)"
        ends.append(f"IF(sum(n{i}) > 0, kll_sketch_get_quantile_double({merged}, {_grid(shares)}), NULL)")
    row = parts.selectExpr(f"array({', '.join(ends)}) AS ends").first()
    return [_joined(found) if found else [] for found in row["ends"]]


def _number(cuts: Sequence[Sequence[tuple[float, float]]], i: int) -> int:
    """How many brackets the columns up to ``i`` have."""
    return sum(len(c) for c in cuts[: i + 1])


def _sliced(values: DataFrame, cuts: Sequence[Sequence[tuple[float, float]]], *, between: bool) -> DataFrame:
    """``(slice, value)`` of every value, or of those inside brackets only.

    Brackets are numbered through all columns; with ``between`` so are the slices below, between and above them. The number
    is found from constants before the row is unfolded.
    """
    slices, number = [], 0
    for i, column in enumerate(cuts):
        cases = []
        for low, high in column:
            if between:
                cases += [f"WHEN v{i} < {low!r}D THEN {number}", f"WHEN v{i} <= {high!r}D THEN {number + 1}"]
                number += 2
            else:
                cases.append(f"WHEN v{i} BETWEEN {low!r}D AND {high!r}D THEN {number}")
                number += 1
        if between:
            slices.append(f"CASE WHEN v{i} IS NULL THEN NULL {' '.join(cases)} ELSE {number} END AS s{i}")
            number += 1
        elif cases:
            slices.append(f"CASE {' '.join(cases)} END AS s{i}")
    names = [s.rsplit(" AS s", 1)[1] for s in slices]
    wide = values.selectExpr(*[f"v{i}" for i in names], *slices)
    if not between:
        wide = wide.filter(f"coalesce({', '.join(f's{i}' for i in names)}) IS NOT NULL")
    pairs = ", ".join(f"(s{i}, v{i}) AS c{i}" for i in names)
    long = values.sparkSession.sql(f"SELECT slice, value FROM {{wide}} UNPIVOT INCLUDE NULLS ((slice, value) FOR c IN ({pairs}))", wide=wide)
    return long.filter("slice IS NOT NULL")


def _located(values: DataFrame, cuts: list[list[tuple[float, float]]], points: Sequence[float]) -> list[_Column | None]:
    """For each column the brackets that hold its wanted ranks, none with more than ``NARROW`` rows of several values."""
    before: dict[tuple[int, float, float], int] = {}
    while True:
        found = [_bracketed(slices, points) for slices in _counted(values, cuts)]
        wide = [(i, b) for i, b in _all(found) if b.count > NARROW and b.low < b.high and before.get((i, b.low, b.high)) != b.count]
        if not wide:
            return found
        before = {(i, b.low, b.high): b.count for i, b in wide}
        narrower = _narrowed(values, wide)
        cuts = [[] for _ in cuts]
        for i, b in _all(found):
            cuts[i] += narrower.get((i, b.low, b.high), [(b.low, b.high)])


def _all(found: Sequence[_Column | None]) -> Iterator[tuple[int, _Bracket]]:
    for i, column in enumerate(found):
        for bracket in column.brackets if column else ():
            yield i, bracket


def _counted(values: DataFrame, cuts: Sequence[Sequence[tuple[float, float]]]) -> list[list[tuple[int, float, float]]]:
    """Rows, smallest and largest value of every slice of each column that has any, in order."""
    counts = _sliced(values, cuts, between=True).groupBy("slice").agg(
        F.expr("count(*) AS cnt"), F.expr("min(value) AS lo"), F.expr("max(value) AS hi")
    )
    rows = {r["slice"]: (r["cnt"], r["lo"], r["hi"]) for r in counts.collect()}  # a few rows per column and point
    out, number = [], 0
    for column in cuts:
        size = 2 * len(column) + 1
        out.append([rows[k] for k in range(number, number + size) if k in rows])
        number += size
    return out


def _bracketed(slices: Sequence[tuple[int, float, float]], points: Sequence[float]) -> _Column | None:
    """The slices that hold a wanted rank; all rows between a slice's extremes are its own."""
    if not slices:
        return None
    n = sum(count for count, _, _ in slices)
    ranks = []
    for p in points:
        place = p * (n - 1)
        low = math.floor(place)
        ranks += [(p, False, low, place - low), (p, True, min(low + 1, n - 1), place - low)]
    brackets, passed = [], 0
    for count, low, high in slices:
        held = [r for r in ranks if passed <= r[2] < passed + count]
        if held:
            brackets.append(_Bracket(low, high, passed, count, held))
        passed += count
    return _Column(n, slices[0][1], slices[-1][2], brackets)


def _narrowed(values: DataFrame, wide: Sequence[tuple[int, _Bracket]]) -> dict[tuple[int, float, float], list[tuple[float, float]]]:
    """Brackets inside brackets, from a sketch of the rows of each."""
    width = len(values.columns)
    cuts: list[list[tuple[float, float]]] = [[] for _ in range(width)]
    for i, b in wide:
        cuts[i].append((b.low, b.high))
    order = sorted(range(len(wide)), key=lambda k: (wide[k][0], wide[k][1].low))
    cuts = [sorted(c) for c in cuts]
    grids = []
    for at, k in enumerate(order):
        b = wide[k][1]
        shares = _margins([(rank - b.before) / max(b.count - 1, 1) for _, _, rank, _ in b.ranks])
        grids.append(f"WHEN {at} THEN kll_sketch_get_quantile_double(s, {_grid(shares)})")
    part = F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("_part")
    sketches = _sliced(values, cuts, between=False).groupBy("slice", part).agg(F.expr(f"kll_sketch_agg_double(value, {SKETCH_SIZE}) AS s"))
    merged = sketches.groupBy("slice").agg(F.expr(f"kll_merge_agg_double(s, {SKETCH_SIZE}) AS s"))
    rows = merged.selectExpr("slice", f"CASE slice {' '.join(grids)} END AS ends").collect()
    found = {r["slice"]: _joined(r["ends"]) for r in rows}
    return {(wide[k][0], wide[k][1].low, wide[k][1].high): found[at] for at, k in enumerate(order)}
