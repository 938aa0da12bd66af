"""Frequent values of columns with long texts, against a count in plain Python."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabscope.operators import profile

START = "<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'>" * 3
TEXT = st.one_of(st.none(), st.sampled_from(["", "a", "b", "\0144:x"]), st.integers(0, 12).map(lambda i: f"{START}{i}é"))


def expected(rows, names, limit):
    out = {}
    for i, name in enumerate(names):
        counted = Counter(r[i] for r in rows if r[i] is not None)
        best = sorted(counted.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:limit]
        out |= {(name, place): pair for place, pair in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("sent", [0, 2, 1000])
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(TEXT, TEXT), max_size=30), limit=st.integers(1, 6))
def test_any_table(spark, sent, rows, limit):
    kept, profile._SENT = profile._SENT, sent
    try:
        df = spark.createDataFrame(rows, "`a.b` string, value string")
        got = {(r["column"], r["position"]): (r["value"], r["count"]) for r in profile.top_values(df, limit=limit).collect()}
        unique = {r["column"]: r["unique_value_count"] for r in profile.profile_string(df, limit=limit).collect()}
    finally:
        profile._SENT = kept
    assert got == expected(rows, ["a.b", "value"], limit)
    present = {c: {r[i] for r in rows} - {None} for i, c in enumerate(["a.b", "value"])}
    assert unique == {c: len(v) for c, v in present.items() if v}


def test_short_and_long_columns(spark):
    rows = [(START * 40 + str(i % 3), "x", None) for i in range(7)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "text string, short string, gap string")
    got = {r["column"]: (r["most_common_value"], r["most_common_value_count"]) for r in profile.profile_string(df).collect()}
    assert got == {"text": (START * 40 + "0", 3), "short": ("x", 7)}
    assert profile.top_values(df.limit(0)).count() == 0


def test_long_texts_do_not_travel(spark):
    """Beyond the digests only the few texts of the list pass a shuffle."""
    rows = [(START * 200 + str(i),) for i in range(400)] + [(START * 200 + "7",)] * 5
    df = spark.createDataFrame(rows, "text string")
    top = profile.top_values(df)
    assert [r["count"] for r in top.orderBy("position").collect()] == [6, 1, 1, 1, 1]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan
