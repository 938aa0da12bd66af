from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import cleanse, quality

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [
            (1, 1.0, "a", None, 5),
            (2, NAN, "a", None, 5),
            (3, 3.0, None, None, 5),
            (4, None, "b", None, 5),
            (5, INF, "b", None, 5),
            (None, 2.0, "c", None, 5),
        ],
        "id int, x double, s string, nothing string, flat int",
    )


def ids(df):
    return sorted(r["id"] if r["id"] is not None else 0 for r in df.collect())


def test_missing_rows(gaps):
    known = gaps.drop("nothing")
    assert ids(quality.missing_rows(known)) == [0, 2, 3, 4]
    assert ids(cleanse.delete_missing_row(known)) == [1, 5]
    assert ids(cleanse.drop_missing(gaps, "s")) == [0, 1, 2, 4, 5]
    assert quality.missing_rows(gaps).count() == 6


def test_copies_of_whole_rows(spark, monkeypatch):
    rows = [(1, "x")] * 5 + [(None, "y")] * 3 + [(2, None), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    monkeypatch.setattr(quality, "COPIES_PER_TASK", 2)
    got = Counter(tuple(r) for r in quality.duplicate_rows(df).collect())
    assert got == {(1, "x"): 4, (None, "y"): 2, (None, None): 1}
    assert quality.duplicate_count(df).first()["duplicates"] == 7
    assert cleanse.delete_duplicate_row(df).count() == 4


def test_copies_by_subset_follow_the_order(spark):
    long = "z" * 500
    rows = [(3, "a"), (1, "a"), (2, "b"), (9, long), (4, long), (5, long + "!"), (7, None), (6, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    assert ids(quality.duplicate_rows(df, "text", "id")) == [3, 7, 9]
    assert ids(cleanse.delete_duplicate_row(df, "text", "id")) == [1, 2, 4, 5, 6]
    with pytest.raises(ValueError):
        quality.duplicate_rows(df, "text")
    with pytest.raises(ValueError):
        cleanse.delete_duplicate_row(df, "text")


def test_copies_by_subset_with_ties_and_missing_keys(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("b", 2)], "s string, k int")
    assert quality.duplicate_rows(df, "s", "k").collect() == [("b", 2)]
    assert sorted(map(tuple, cleanse.delete_duplicate_row(df, "s", "k").collect()), key=repr) == [("a", None), ("b", 1)]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 2)], "s string, k int")
    assert sorted(map(tuple, quality.duplicate_rows(df, "s", "k").collect())) == [("a", 2), ("b", 2), ("b", 3)]
    assert sorted(map(tuple, cleanse.delete_duplicate_row(df, "s", "k").collect())) == [("a", 1), ("b", 2)]


def test_one_group_holds_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert quality.duplicate_rows(df).count() == 9_999
    assert quality.duplicate_rows(df.withColumn("n", F.monotonically_increasing_id()), "k", "n").count() == 9_999


def test_maps_are_rejected(spark):
    df = spark.sql("SELECT map('a', 1) AS m, 1 AS id")
    for run in (quality.duplicate_rows, quality.duplicate_count, cleanse.delete_duplicate_row):
        with pytest.raises(ValueError, match="map"):
            run(df)


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 500), [50.0, 50.0, -40.0, 8.0]])
    df = spark.createDataFrame([(i, float(v), 7) for i, v in enumerate(values)], "id int, x double, flat int")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    by_iqr = {i for i, v in enumerate(values) if v < low or v > high}
    by_z = {i for i, v in enumerate(values) if abs((v - values.mean()) / values.std()) > 3}
    assert set(ids(quality.iqr_outliers(df, "x"))) == by_iqr
    assert set(ids(quality.zscore_outliers(df, "x"))) == by_z
    assert quality.zscore_outliers(df, "flat").count() == 0
    flagged = {r["value"] for r in quality.outlier_values(df.drop("id")).collect()}
    assert flagged == {values[i] for i in by_iqr | by_z}
    kept = cleanse.delete_row_outlier(df.drop("id").withColumn("id", F.lit(1)), ["x"])
    assert kept.count() == len(values) - len(by_iqr | by_z)


def test_missing_values_do_not_hide_outliers(spark):
    rows = [(float(i % 10), float(i % 10)) for i in range(200)] + [(None, 1000.0), (1000.0, 1000.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = {(r["column"], r["value"]) for r in quality.outlier_values(df).collect()}
    assert found == {("a", 1000.0), ("b", 1000.0)}
    whole = {(r["column"], r["value"]) for r in quality.outlier_values(df, skip_nullable=True).collect()}
    assert whole == {("b", 1000.0)}
    # A missing cell is no outlier.
    assert cleanse.delete_row_outlier(df, ["a"]).count() == 201


def test_report(gaps):
    counts = {(r["measure"], r["column"]): r["total"] for r in quality.quality_counts(gaps).collect()}
    assert counts[("missing_rows", "")] == 6 and counts[("duplicate_rows", "")] == 0
    assert {c for m, c in counts if m == "outliers"} == {"id", "x", "flat"}
    report = {(r["measure"], r["column"]): r["value"] for r in quality.quality_report(gaps).collect()}
    assert report[("data_type", "x")] == "double" and report[("missing_rows", "")] == "6"


def test_imputing(gaps):
    means = {r["id"]: r for r in cleanse.impute_by_mean(gaps, "x").collect()}
    assert means[2]["x"] == 2.0 and means[5]["x"] == 2.0 and means[3]["x"] == 3.0 and means[1]["s"] == "a"
    filled = cleanse.impute_by_mean(gaps)
    assert filled.filter("s = 'c'").first()["id"] == 3.0 and filled.columns == gaps.columns
    modes = cleanse.impute_by_mode(gaps.select("id", "x", "s", "flat"), ["s", "x"]).collect()
    by_id = {r["id"]: r for r in modes}
    assert by_id[3]["s"] == "a"  # a and b are equally frequent
    assert by_id[4]["x"] == 1.0 and by_id[2]["x"] == 1.0
    assert by_id[None]["flat"] == 5


def test_mode_of_many_types(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, 10L, TRUE, DATE'2024-01-02', CAST(1.5 AS DECIMAL(5,2)), 'b'),
        (2, 9L, NULL, NULL, NULL, 'a'), (3, 9L, TRUE, DATE'2024-01-02', CAST(1.5 AS DECIMAL(5,2)), NULL)
        AS t(id, n, flag, day, money, s)"""
    )
    filled = cleanse.impute_by_mode(df)
    assert filled.dtypes == df.dtypes
    row = filled.filter("id = 2").first()
    assert row["flag"] is True and str(row["day"]) == "2024-01-02" and str(row["money"]) == "1.50"
    assert filled.filter("id = 3").first()["s"] == "a"


def test_conversion_and_cells(spark):
    df = spark.createDataFrame([("1", "2024-01-02", 1.5), ("12d", "x", None)], "a string, d string, x double")
    out = cleanse.convert_types(df, {"a": "int", "d": "date", "x": "string"})
    assert [tuple(map(str, r)) for r in out.collect()] == [("1", "2024-01-02", "1.5"), ("None", "None", "None")]
    cells = {tuple(r) for r in cleanse.remove_missing_cell(df, "a").collect()}
    assert cells == {("1", "d", "2024-01-02"), ("1", "x", "1.5"), ("12d", "d", "x")}
    with pytest.raises(ValueError):
        cleanse.convert_types(df, {"zzz": "int"})


def test_steps(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "a int, b string")
    once = cleanse.cleanse(df, ["delete_duplicate_row", "delete_missing_row"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "c")]
    twice = cleanse.cleanse(once, ["delete_duplicate_row", "delete_missing_row"])
    assert sorted(twice.collect()) == sorted(once.collect())
    every = cleanse.cleanse(df, cleanse.fixed.CLEANSING_STEPS, types={"a": "double"}, keys="b")
    assert {tuple(r) for r in every.collect()} == {("a", "a", "1.0"), ("c", "a", "2.0")}
    with pytest.raises(ValueError):
        cleanse.cleanse(df, ["polish"])


def test_rows_that_differ_in_gaps_alone_are_no_copies(spark):
    rows = [(1, "a", None, 0.0), (1, None, "a", 0.0), (1, "a", None, NAN), (1, "a", None, None), (1, "a", None, -0.0), (1, "a", None, NAN)]
    df = spark.createDataFrame(rows, "k int, x string, y string, z double")
    assert quality.duplicate_count(df).first()["duplicates"] == 2
    later = quality.duplicate_rows(df, "k", "z").collect()
    assert len(later) == 5 and sum(r["z"] is None for r in later) == 0


def test_copies_are_merged_once_for_later_readings(spark):
    """Outlier limits and means are looked up in a stored table, not by merging copies again."""
    df = spark.range(40).selectExpr("id div 2 AS id", "IF(id > 37, 1e6D, double(id div 4)) AS x")
    got = cleanse.cleanse(df, ["delete_duplicate_row", "delete_row_outlier"])
    assert any("cleansed-" in f for f in got.inputFiles())
    want = cleanse.delete_row_outlier(cleanse.delete_duplicate_row(df))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.schema.simpleString() == want.schema.simpleString() and got.count() == 19
    # NULL-typed columns cannot be stored; the steps work all the same.
    odd = df.selectExpr("id", "x", "NULL AS nothing")
    assert cleanse.cleanse(odd, ["delete_duplicate_row", "delete_row_outlier"]).count() == 19
