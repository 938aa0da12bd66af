import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators import paging, ranges, series


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    days = [None, *(datetime.date(2020, 1, 1) + datetime.timedelta(d) for d in range(9))]
    rows = [(rng.choice(days), rng.choice([None, float("nan"), 0.5, -1.0, 2.0]), rng.choice("abc"), i) for i in range(5000)]
    return spark.createDataFrame(rows, "day date, x double, s string, id int").repartition(7)


@pytest.mark.parametrize("order", [["day", "-x", "s", "id"], ["-day", "x", "-s", "-id"], ["id"], ["-id"], ["s", "-id"]])
def test_deep_pages_are_slices_of_the_sorted_table(table, order, monkeypatch):
    monkeypatch.setattr(ranges, "SAMPLE", 300)
    columns = [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in order]
    whole = [r["id"] for r in table.orderBy(*columns).collect()]
    for first in (0, 90, 2500, 4900, 4990):
        page = paging.page_slice(table, order, first // 10 + 1, 10, narrow=100)
        assert [r["id"] for r in page.collect()] == whole[first : first + 10]
    assert paging.page_slice(table, order, 501, 10, narrow=100).count() == 0
    assert [r["id"] for r in paging.page_slice(table, order, 2, 3000, narrow=100).collect()] == whole[3000:]


def test_a_deep_page_sorts_few_rows(spark, table):
    page = paging.page_slice(table, ["id"], 300, 10, narrow=200)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "GreaterThanOrEqual" in plan or ">=" in plan
    limits = [int(w) for w in plan.replace("(", " ").replace(")", " ").split() if w.isdigit()]
    assert "Sort" in plan and max(limits, default=0) < 5000


def test_equal_keys_and_unlucky_samples(spark, monkeypatch):
    same = spark.range(1000).withColumn("k", F.lit(1))
    assert paging.page_slice(same, ["k"], 50, 10, narrow=20).count() == 10
    monkeypatch.setattr(ranges, "SAMPLE", 4)
    rows = spark.range(0, 3000, 1, 5).withColumn("k", (F.col("id") * 7919) % 3001)
    whole = [r["id"] for r in rows.orderBy("k").collect()]
    assert [r["id"] for r in paging.page_slice(rows, ["k"], 200, 10, narrow=50).collect()] == whole[1990:2000]


def test_pages_larger_than_allowed_are_refused(table):
    with pytest.raises(ValueError, match="at most 50"):
        paging.page_slice(table, ["id"], 1, 51, max_size=50)


def test_running_sums(spark):
    rows = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5003).alias("k"), F.lit(0.5).alias("v"))
    got = ranges.running_sums(rows, [F.col("k").asc()], "v").orderBy("position").collect()
    keys = sorted(r["k"] for r in rows.collect())
    assert [(r["k"], r["position"], r["end"], r["size"]) for r in got] == [(k, i + 1, (i + 1) / 2, 5000) for i, k in enumerate(keys)]
    assert ranges.running_sums(rows.limit(0), [F.col("k").asc()], "v").collect() == []


def test_waterfall_over_all_groups(spark):
    rows = spark.range(1500).select(F.col("id").alias("size"), F.lit(1.0).alias("v"))
    got = series.waterfall_series(rows, "size", "v", None).orderBy("position").collect()
    assert len(got) == 1501 and got[-1]["measure"] == "total" and got[-1]["end"] == 1500.0
    assert [r["start"] for r in got[:-1]] == [float(i) for i in range(1500)]
    window = series.waterfall_series(rows, "size", "v", None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in window and "_range" in window
