import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators.histogram import (
    bin_count,
    datetime_histogram,
    equal_width_bucket,
    fixed_histogram,
    histogram,
)

METHODS = ["fd", "sturges", "rice", "sqrt", "doane", "scott", "custom", "unheard of"]


def numpy_bins(data, method):
    n, span = len(data), data.max() - data.min()
    q1, q3 = np.percentile(data, [25, 75])
    if method == "sturges":
        return max(1, math.ceil(math.log2(n) + 1))
    if method == "rice":
        return max(1, math.ceil(2 * np.cbrt(n)))
    if method == "sqrt":
        return max(1, math.ceil(math.sqrt(n)))
    if method == "doane":
        spread = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
        return max(1, int(1 + math.log2(n) + math.log2(1 + abs(pd.Series(data).skew()) / spread)))
    if method == "custom":
        return 10
    width = 3.5 * np.std(data) / np.cbrt(n) if method == "scott" else 2 * (q3 - q1) / np.cbrt(n)
    return max(1, math.ceil(span / (width or 1)))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    return np.round(rng.gamma(2.0, 3.0, 3000), 2)


@pytest.mark.parametrize("method", METHODS)
def test_rules_and_counts_match_numpy(spark, data, method):
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    bins = numpy_bins(data, method)
    assert bin_count(df, "x", method).first()["bins"] == bins
    rows = histogram(df, "x", method).orderBy("index").collect()
    counts, edges = np.histogram(data, bins=bins)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["left_value"] for r in rows] == pytest.approx(edges[:-1].tolist(), rel=1e-12)
    assert rows[-1]["right_value"] == edges[-1]
    assert sum(r["count"] for r in rows) == len(data)


def test_edges_that_mislead_the_quotient(spark):
    data = np.array([i / 100 for i in range(11)] * 40)
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    rows = fixed_histogram(df, "x", 15).orderBy("index").collect()
    assert [r["count"] for r in rows] == np.histogram(data, bins=15)[0].tolist()
    at = equal_width_bucket(F.col("x"), F.lit(0.0), F.lit(0.1), F.lit(15))
    again = df.groupBy(at.alias("b")).count()
    filled = {r["index"]: r["count"] for r in rows if r["count"]}
    assert {r["b"]: r["count"] for r in again.collect()} == filled


@pytest.mark.parametrize("values", [[3.0], [3.0, 3.0, 3.0], [1.0, 2.0]])
def test_flat_and_tiny(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for bins in (1, 4, 5):
        rows = fixed_histogram(df, "x", bins).orderBy("index").collect()
        counts, edges = np.histogram(values, bins=bins)
        assert [r["count"] for r in rows] == counts.tolist()
        assert [r["left_value"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert histogram(df, "x", "doane").count() >= 1


def test_empty_column_has_no_bins(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert {r["column"] for r in histogram(df, ["x", "y"]).collect()} == {"y"}


def test_far_outlier_keeps_empty_bins(spark):
    data = np.array([0.0] * 5 + [1.0] * 5 + [1000.0])
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    rows = fixed_histogram(df, "x", 50).orderBy("index").collect()
    assert [r["count"] for r in rows] == np.histogram(data, bins=50)[0].tolist()


def test_datetimes(spark):
    moments = pd.date_range("2024-01-01", periods=100, freq="7h") + pd.Timedelta("0.7s")
    df = spark.createDataFrame([(m.to_pydatetime(),) for m in moments], "t timestamp")
    rows = datetime_histogram(df, "t").orderBy("index").collect()
    counts, edges = np.histogram(moments.astype(np.int64) // 10**9, bins=10)
    assert [r["count"] for r in rows] == counts.tolist()
    assert rows[0]["left_value"] == "2024-01-01T00:00:00"
    assert rows[3]["left_value"] == pd.to_datetime(edges[3] * 1e9).isoformat()
    assert rows[0]["label"] == "2024-01-01 - 2024-01-03"


def test_many_bins_are_filled_by_many_tasks(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2_000_000.0,)], "x double")
    bins = fixed_histogram(df, "x", 2_000_000)
    totals = bins.agg(F.count("*").alias("n"), F.sum("count").alias("rows"), F.max("index").alias("last")).first()
    assert tuple(totals) == (2_000_000, 3, 1_999_999)
    assert "Window" not in bins._jdf.queryExecution().optimizedPlan().toString()
