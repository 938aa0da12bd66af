import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import kpi, series
from tabscope.plans import requests

VALUES = ["3", "1", "x", None, "2.5", "1", "nan"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v, "b" if i % 2 else "a", float(i)) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "i int, v string, k string, y double")


def card(df):
    return {r["field"]: r for r in df.collect()}


def test_number_cards_match_pandas(table):
    numbers = pd.to_numeric(pd.Series(VALUES), errors="coerce").dropna()
    want = {
        "sum": numbers.sum(),
        "average": numbers.mean(),
        "count": len(numbers),
        "minimum": numbers.min(),
        "maximum": numbers.max(),
        "std_deviation": numbers.std(),
        "variance": numbers.var(),
        "median": numbers.median(),
        "count_distinct": numbers.nunique(),
    }
    for aggregation, value in want.items():
        row = card(kpi.kpi_number(table, aggregation, ["v", "y"]))["v"]
        assert row["value"] == pytest.approx(value), aggregation
        assert row["message"] == f"{aggregation} of v".capitalize()
        assert float(row["value_text"]) == pytest.approx(value, abs=0.006)


def test_number_cards_without_numbers(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert card(kpi.kpi_number(df, "sum", "v"))["v"]["value"] == 0
    assert card(kpi.kpi_number(df, "median", "v"))["v"]["value"] is None
    one = spark.createDataFrame([(1.0,)], "v double")
    assert card(kpi.kpi_number(one, "variance", "v"))["v"]["value"] is None


def test_category_cards(table):
    first = card(kpi.kpi_category(table, "first", ["k", "v"], "i"))
    assert (first["k"]["value"], first["v"]["value"]) == ("a", "3")
    assert card(kpi.kpi_category(table, "last", "v", "i"))["v"]["value"] == "nan"
    assert card(kpi.kpi_category(table, "count", "v"))["v"]["value"] == "7"
    assert card(kpi.kpi_category(table, "count_distinct", "v"))["v"]["value"] == "5"
    assert card(kpi.kpi_cards(table, "category", "count", "k"))["k"]["message"] == "Count of k"


def test_bad_requests(table):
    for run in (
        lambda: kpi.kpi_number(table, "first", "v"),
        lambda: kpi.kpi_category(table, "sum", "v"),
        lambda: kpi.kpi_category(table, "first", "v"),
        lambda: kpi.kpi_number(table, "sum", "zzz"),
        lambda: kpi.kpi_cards(table, "colour", "sum", "v"),
        lambda: series.chart(table, "cake_chart", "k"),
        lambda: series.chart(table, "bar_chart", "k"),
        lambda: series.chart(table, "map_chart", "k", "y"),
        lambda: series.waterfall_series(table, "k", "y", 0),
        lambda: series.group_sum(table, "k", "y", order="colour"),
    ):
        with pytest.raises(ValueError):
            run()


def test_group_sum_takes_the_first_groups(spark):
    rows = [(f"k{i:02d}", str(i)) for i in range(15)] + [(None, "99"), ("k00", "a-1.5"), ("k01", "")]
    df = spark.createDataFrame(rows, "k string, v string")
    got = [tuple(r) for r in series.group_sum(df, "k", "v").collect()]
    assert got == [("k00", 1.5), ("k01", 1.0)] + [(f"k{i:02d}", float(i)) for i in range(2, 10)]
    assert series.group_sum(df, "k", "v", None).count() == 15
    assert series.group_sum(df, "k", "v", 2, order="value").collect()[0]["k"] == "k14"


def test_group_without_values_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", -2.0), ("b", math.nan)], "k string, v double")
    assert [tuple(r) for r in series.group_sum(df, "k", "v").collect()] == [("a", 0.0), ("b", -2.0)]


def test_value_counts_and_shares(spark):
    values = ["b", "a", "b", "a", "c", None] + [f"z{i:02d}" for i in range(12)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    counts = [tuple(r) for r in series.value_counts(df, "v").collect()]
    assert counts[:3] == [("a", 2), ("b", 2), ("c", 1)] and len(counts) == 10
    shares = series.share_series(df, "v").collect()
    assert sum(r["percent"] for r in shares) == pytest.approx(100, abs=0.5)
    assert shares[0]["percent"] == round(2 / 12 * 100, 1)


def test_pairs(table):
    area = series.chart(table, "area_chart", "k", "v", order_by="-i").collect()
    assert [tuple(r) for r in area][:2] == [("a", "nan"), ("b", "1")]
    heat = series.chart(table, "heatmap", "v", "y", order_by="i").collect()
    assert [tuple(r) for r in heat] == [(3.0, 0.0), (1.0, 1.0), (2.5, 4.0), (1.0, 5.0)]


def test_bubbles(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 20.0), ("c", 900.0)], "k string, v double")
    rows = {r["k"]: r for r in series.bubble_series(df, "k", "v").collect()}
    assert [rows[k]["size"] for k in "abc"] == [50.0, 200.0, 2000.0]
    assert rows["a"]["colour"] == 0 and rows["c"]["colour"] == 1
    assert rows["b"]["y_low"] == pytest.approx(0.9) and rows["b"]["y_high"] == pytest.approx(990)
    assert {tuple(r) for r in series.bubble_series(df, "k", "v", None).collect()} == {tuple(r) for r in rows.values()}
    flat = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert series.bubble_series(flat, "k", "v").first()["colour"] == 0


def test_waterfall_ends_with_the_total(spark):
    df = spark.createDataFrame([(2, 5.0), (1, 3.0), (3, 1.0)], "k int, v double")
    rows = [tuple(r) for r in series.waterfall_series(df, "k", "v").orderBy("position").collect()]
    assert rows == [
        (1, "1", "relative", 3.0, 0.0, 3.0),
        (2, "2", "relative", 5.0, 3.0, 8.0),
        (3, "3", "relative", 1.0, 8.0, 9.0),
        (4, "total", "total", 9.0, 0.0, 9.0),
    ]


def test_map(spark):
    countries = spark.createDataFrame([(" France",), ("PERU",), ("Chad",)], "ADMIN string")
    data = spark.createDataFrame(
        [("france ", 1.0), ("FRANCE", 5.0), ("Peru", None), ("Atlantis", 9.0), ("Atlantis", 2.0), (None, 1.0)],
        "place string, v double",
    )
    rows = [tuple(r) for r in series.map_series(data, "place", "v", countries, strict=True).collect()]
    assert rows == [("france", 5.0), ("france", 1.0)]
    assert tuple(series.map_summary(data, "place", "v", countries).first()) == (1.0, 5.0, 2)
    assert [tuple(r) for r in series.unmatched_places(data, "place", countries).collect()] == [("atlantis", 2)]
    with pytest.raises(ValueError, match="no place"):
        series.map_series(data.filter("place = 'Atlantis'"), "place", "v", countries, strict=True)
    with pytest.raises(ValueError, match="holds places"):
        series.map_series(data, "zzz", "v", countries)
    with pytest.raises(ValueError, match="no place"):
        series.chart(data.filter("place = 'Atlantis'"), "map_chart", "place", "v", countries=countries)
    named = data.withColumnRenamed("place", "NAME")
    assert series.map_series(named, "zzz", "v", countries).count() == 2


def test_raw_tables_are_typed_by_role(spark):
    df = spark.createDataFrame([(1, "$5", "a"), (2, "$7.5", "b"), (3, "9 EUR", "b")], "i int, v string, k string")
    assert [tuple(r) for r in requests.chart_of(df, "bar_chart", "k", "v", order_by="i").collect()] == [
        ("a", 5.0),
        ("b", 16.5),
    ]
    cards = card(requests.cards_of(df, "number", "sum", ["v", "k"], order_by="i"))
    assert cards["v"]["value"] == 21.5 and cards["k"]["value"] == 0


def test_histogram_series(spark):
    df = spark.range(100).select(F.concat(F.lit("$"), F.col("id").cast("string")).alias("v"))
    rows = series.chart(df, "histogram", "v").collect()
    assert len(rows) == 15 and sum(r["count"] for r in rows) == 100
