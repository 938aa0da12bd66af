import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import quantiles as Q

POINTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def exact(df, columns, points=POINTS):
    return {(r["column"], r["point"]): r for r in Q.exact_quantiles(df, columns, points).collect()}


def test_against_numpy_on_many_shapes(spark):
    rng = np.random.default_rng(3)
    n = 6000
    shapes = {
        "uniform": rng.random(n),
        "heavy": rng.standard_cauchy(n) * 1e6,
        "one_value_third": np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n) * 1e-9 + 7),
        "clusters": np.concatenate([1e9 + rng.random(n // 2), -1e-9 * rng.random(n - n // 2)]),
        "whole": rng.integers(0, 5, n).astype(float),
        "huge": rng.choice([-1.7e308, 1.7e308, 0.0], n),
    }
    df = spark.createDataFrame(
        list(zip(*[v.tolist() for v in shapes.values()], strict=True)), ", ".join(f"{k} double" for k in shapes)
    )
    found = exact(df, list(shapes))
    for name, values in shapes.items():
        assert {k[1] for k in found if k[0] == name} == set(POINTS)
        for p in POINTS:
            row = found[(name, p)]
            with np.errstate(all="ignore"):
                want = np.quantile(values, p)
            if np.isfinite(want):
                assert row["value"] == pytest.approx(want, rel=1e-12, abs=0), (name, p)
            assert (row["n"], row["lo"], row["hi"]) == (n, values.min(), values.max())


def test_gaps_nonfinite_and_empty_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, True), (float("nan"), None, False), (3.0, None, True), (float("inf"), None, None), (None, None, None)],
        "x double, nothing double, flag boolean",
    )
    found = exact(df, ["x", "nothing", "flag"], [0.5])
    assert set(found) == {("x", 0.5), ("flag", 0.5)}
    assert found[("x", 0.5)]["value"] == 2.0 and found[("x", 0.5)]["n"] == 2
    assert found[("flag", 0.5)]["value"] == 1.0
    assert Q.exact_quantiles(df.filter("x > 100000 AND x < 100001"), ["x"], [0.5]).count() == 0


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [4.0] * 9])
def test_tiny_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for p in (0.0, 0.25, 0.5, 1.0):
        assert exact(df, ["x"], [p])[("x", p)]["value"] == np.quantile(values, p)


def test_strip_text_dots_and_limits(spark):
    df = spark.createDataFrame([("$1",), ("2 EUR",), ("9",)], "`a.b` string")
    rows = Q.exact_quantiles(df, ["a.b"], [0.5], strip=True).collect()
    assert [(r["column"], r["value"]) for r in rows] == [("a.b", 2.0)]
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, ["a.b"], [1.5])
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, [], [0.5])


@pytest.mark.parametrize(("narrow", "size", "margin"), [(10, 8, 0.3), (10, 8, 1e-9), (1, 200, 0.01), (100, 4000, 0.002)])
def test_brackets_get_narrower_and_a_wrong_sketch_is_noticed(spark, monkeypatch, narrow, size, margin):
    """Small sketches miss ranks, tiny brackets have to be looked for again; equal values cannot be narrowed."""
    monkeypatch.setattr(Q, "NARROW", narrow)
    monkeypatch.setattr(Q, "SKETCH_SIZE", size)
    monkeypatch.setattr(Q, "MARGIN", margin)
    x = F.col("id") * F.col("id") % 997
    df = spark.range(3000).select(x.cast("double").alias("x"), (F.col("id") % 2).alias("two"), F.lit(1).alias("one"))
    values = {"x": [i * i % 997 for i in range(3000)], "two": [i % 2 for i in range(3000)], "one": [1] * 3000}
    found = exact(df, list(values))
    assert len(found) == 3 * len(POINTS)
    for (name, p), row in found.items():
        assert row["value"] == pytest.approx(np.quantile(values[name], p), rel=1e-12), (name, p)


def test_only_rows_inside_brackets_reach_the_last_job(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    values = df.select(F.col("x").alias("v0"))
    column = Q._located(values, Q._sketched(values, 1, [0.25, 0.5]), [0.25, 0.5])[0]
    assert len(column.brackets) == 2 and sum(b.count for b in column.brackets) < 4 * 2 * Q.MARGIN * 200_000
    assert Q._sliced(values, [[(b.low, b.high) for b in column.brackets]], between=False).count() == sum(b.count for b in column.brackets)


def test_many_columns(spark):
    df = spark.range(500).select(*[(F.col("id") * (i + 1) % 101).alias(f"c{i}") for i in range(60)])
    found = exact(df, df.columns, [0.5])
    assert {name: row["value"] for (name, _), row in found.items()} == {f"c{i}": np.median([k * (i + 1) % 101 for k in range(500)]) for i in range(60)}


def test_approximate(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    rows = {r["point"]: r["value"] for r in Q.approximate_quantiles(df, ["x"], [0.25, 0.5]).collect()}
    assert abs(rows[0.25] - 250) <= 1 and abs(rows[0.5] - 500) <= 1
