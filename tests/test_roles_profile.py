import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import columns, profile, roles


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        [
            (2, "5 EUR", "12", "2024-01-02", "01/02/2024", "2 Jan 2024", "x", None, None, 1.0, True),
            (1, "$5", "12", "2024-1-3", "12/31/2024", "13 Feb 2024", "y", "7", None, -2.0, False),
            (3, "$6", "a", "2023-02-28", "02/03/2024", "1 Mar 2024", "z", "8", None, math.nan, None),
        ],
        "id int, money string, late string, iso string, us string, wordy string, plain string, gap string,"
        " empty string, x double, flag boolean",
    )


def test_roles(texts):
    found = {r["column"]: r["role"] for r in roles.column_roles(texts, "id").collect()}
    numeric = {"id", "money", "late", "iso", "us", "x", "flag", "gap"}
    assert {c for c, r in found.items() if r == "numeric"} == numeric
    # The first row decides: in the other order it has letters, or is missing.
    turned = texts.withColumn("at", -F.col("id"))
    again = {r["column"]: r["role"] for r in roles.column_roles(turned, "at").collect()}
    assert again["late"] == "object" and again["money"] == "numeric"
    second = {r["column"]: r["role"] for r in roles.column_roles(texts.filter("id <> 1"), "id").collect()}
    assert second["gap"] == "object" and second["money"] == "object"
    counts = roles.role_counts(texts, "id").first()
    assert counts["count_header"] == 11 and set(counts["numeric_columns"]) == numeric


def test_typed_by_role(texts):
    typed = roles.typed_by_role(texts, "id")
    assert dict(typed.dtypes)["money"] == "double" and dict(typed.dtypes)["plain"] == "string"
    assert [r["money"] for r in typed.orderBy("id").collect()] == [5.0, 5.0, 6.0]
    assert [r["x"] for r in typed.orderBy("id").collect()][0] == -2.0


def test_dates(texts):
    formats = roles.date_formats(texts)
    assert formats == {
        "iso": "yyyy-M-d",
        "us": "M/d/yyyy",
        "wordy": "d MMM yyyy",
        "empty": "yyyy-M-d",
    }
    assert {r["column"]: r["date_format"] for r in roles.date_columns(texts).collect()} == formats
    parsed = roles.parse_dates(texts, formats).orderBy("id").first()
    assert parsed["us"] == datetime.datetime(2024, 12, 31) and parsed["wordy"] == datetime.datetime(2024, 2, 13)
    summary = roles.header_summary(texts, "id").first()
    assert summary["header_date"] == ["wordy", "empty"] and summary["count_records"] == 3
    assert summary["header_label"][0]["value"] == "id"


@pytest.mark.parametrize(
    ("values", "pattern"),
    [
        (["2024-01-02", None], "yyyy-M-d"),
        (["01/02/2024", "13/02/2024"], "d/M/yyyy"),
        (["01/02/2024", "02/03/2024"], "M/d/yyyy"),
        (["31-12-2024"], "d-M-yyyy"),
        (["2024/5/6"], "yyyy/M/d"),
        (["2024-05-06T07:08:09Z", "2024-05-06 07:08"], "iso"),
        (["20240506"], "yyyyMMdd"),
        (["May 6, 2024"], "MMM d, yyyy"),
        (["2024-02-30"], None),
        (["2024-01-02", "soon"], None),
        (["12/31/2024", "31/12/2024"], None),
        (["5"], None),
    ],
)
def test_each_date_format(spark, values, pattern):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert roles.date_formats(df).get("d") == pattern
    assert roles.is_date_column(df, "d") is (pattern is not None)


def test_a_late_bad_value_is_found(spark):
    day = F.when(F.col("id") == 4999, "never").otherwise("2024-01-02")
    assert roles.date_formats(spark.range(5000).select(day.alias("d"))) == {}


def test_numeric_profile(spark):
    values = [1.0, 2.0, 2.0, 10.0, math.nan, math.inf, None]
    df = spark.createDataFrame([(v, None) for v in values], "x double, n int")
    finite = np.array([1.0, 2.0, 2.0, 10.0])
    row = {r["column"]: r for r in profile.profile_numeric(df).collect()}["x"]
    assert row["finite_count"] == 4 and row["minimum"] == 1 and row["maximum"] == 10
    assert row["standard_deviation"] == pytest.approx(finite.std())
    counts = {r["column"]: r for r in profile.profile_counts(df).collect()}
    assert tuple(counts["x"])[1:] == (7, 5, 4) and tuple(counts["n"])[1:] == (7, 0, 0)
    points = {r["point"]: r["value"] for r in profile.quantiles(df, "x").collect()}
    assert [points[p] for p in (0.25, 0.5, 0.75)] == np.quantile(finite, [0.25, 0.5, 0.75]).tolist()


def test_text_profile(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", None, "c", "d", "e", "f"]], "s string")
    row = profile.profile_string(df).first()
    assert (row["most_common_value"], row["most_common_value_count"], row["unique_value_count"]) == ("a", 2, 6)
    assert [c["key"] for c in row["counts"]] == ["a", "b", "c", "d", "e"]


def test_datetime_profile(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:00:00'), (TIMESTAMP'2024-01-02 00:00:01'), (NULL) AS t(d)")
    assert tuple(profile.profile_datetime(df).first()) == (
        "d",
        "2024-01-01T12:00:00.500000",
        "2024-01-01T00:00:00",
        "2024-01-02T00:00:01",
    )
    early = spark.sql("SELECT TIMESTAMP'1969-12-31 23:59:59.999999' AS d UNION ALL SELECT TIMESTAMP'1969-12-31 23:59:59.999998'")
    assert profile.profile_datetime(early).first()["mean"] == "1969-12-31T23:59:59.999998"


def test_distinct(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, 0D, 'a', array(1), TRUE), (1, -0D, NULL, array(1), FALSE),
        (2, double('NaN'), 'b', array(2), NULL) AS t(i, x, s, xs, f)"""
    )
    found = {r["column"]: r["unique_value_count"] for r in profile.distinct_per_column(df).collect()}
    assert found == {"i": 2, "x": 1, "s": 2, "xs": 2, "f": 2}
    rough = {r["column"]: r["unique_value_count"] for r in profile.distinct_per_column(df, approximate=True).collect()}
    assert rough["i"] == 2


def test_whole_profile(texts, spark):
    flat = {r["column"]: r for r in profile.profile(texts).collect()}
    assert len(flat) == 11
    assert (flat["id"]["type"], flat["id"]["extended_type"]) == ("NUMERIC", "INTEGER")
    assert (flat["flag"]["type"], flat["flag"]["extended_type"]) == ("NUMERIC", "FLOAT")
    assert flat["us"]["type"] == "DATE_TIME" and flat["us"]["maximum_date"] == "2024-12-31T00:00:00"
    assert flat["x"]["valid_count"] == 2 and flat["x"]["q2"] == -0.5
    assert flat["plain"]["unique_value_count"] == 3
    documents = {r["name"]: r.asDict(True) for r in profile.profile_documents(texts).collect()}
    metrics = documents["id"]["table_column_metrics"]
    assert [q["value"] for q in metrics["numeric_metrics"]["quantiles"]] == [1.5, 2.0, 2.5]
    buckets = metrics["numeric_metrics"]["histogram"]["buckets"]
    counts, edges = np.histogram([1, 2, 3], bins=len(buckets))
    assert [b["count"] for b in buckets] == counts.tolist()
    assert buckets[0]["label"] == f"{edges[0]:.2f} - {edges[1]:.2f}"
    assert metrics["string_metrics"] is None and metrics["date_time_metrics"] is None
    dates = documents["us"]["table_column_metrics"]["date_time_metrics"]
    assert sum(b["count"] for b in dates["histogram"]["buckets"]) == 3
    empty = documents["empty"]["table_column_metrics"]
    assert empty["valid_count"] == 0 and empty["date_time_metrics"]["histogram"]["buckets"] == []


@pytest.mark.parametrize("schema", ["a string", "a double", "a timestamp"])
def test_profile_of_an_empty_table(spark, schema):
    df = spark.createDataFrame([], schema)
    assert profile.profile(df, detect_dates=False).first()["total_count"] == 0
    assert profile.profile_documents(df, detect_dates=False).count() == 1


def test_column_analysis(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "b", "a", None, "c", "d", ""])], "i int, v string")
    row = {r["column"]: r for r in columns.column_analysis(df, "i").collect()}
    assert row["v"]["sample_values"] == ["a", "b", "a", None, "c"]
    assert (row["v"]["total_values"], row["v"]["unique_values"]) == (7, 6)
    assert row["v"]["unique_percentage"] == round(6 / 7 * 100, 2)
    assert row["v"]["is_nullable"] and not row["i"]["is_nullable"]


def test_type_mix(spark):
    values = ["12", " 1_000 ", "-inf", "NaN", "1e5", "TRUE", "false", "2024-01-02", "01/02/2024", "1_", "x", None, "", "0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    mix = columns.type_mix(df).first()

    def share(n):
        return round(n / len(values) * 100, 2)

    assert (mix["numeric"], mix["boolean"], mix["date"], mix["string"]) == (share(6), share(2), share(2), share(4))
