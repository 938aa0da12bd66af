import math

import pytest
from pyspark.sql import functions as F

from tabscope.functions import scalars
from tabscope.functions.scalars import (
    as_number,
    capitalize,
    classify_extension,
    coerce_numeric,
    is_date_text,
    normalize_key,
    nullify,
    sanitize_nonfinite,
    strip_numeric,
    trim_headers,
)

MIXED = {
    "12": (12.0, 12.0),
    " 12 ": (12.0, 12.0),
    "-3.5": (-3.5, 3.5),
    "1e5": (100000.0, 15.0),
    "1_000": (None, 1000.0),
    "12d": (None, 12.0),
    "0x1p3": (None, 13.0),
    "nan": (None, None),
    "inf": (None, None),
    "1e999": (None, 1999.0),
    "true": (None, None),
    "2024-01-02": (None, 20240102.0),
    "": (None, None),
    "1.2.3": (None, None),
    ".": (None, None),
    ".5": (0.5, 0.5),
    "$1,234.50": (None, 1234.5),
    None: (None, None),
}


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numbers_from_text(spark):
    assert column(spark, MIXED, coerce_numeric) == [v[0] for v in MIXED.values()]
    assert column(spark, MIXED, strip_numeric) == [v[1] for v in MIXED.values()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(MIXED)], "i int, v string")
    rows = df.select("i", as_number(df, "v").alias("a"), as_number(df, "v", strip=True).alias("b")).orderBy("i")
    assert [(r["a"], r["b"]) for r in rows.collect()] == list(MIXED.values())


def test_strip_keeps_sign_on_request(spark):
    kept = column(spark, ["-$3.5", "5", "1-2"], lambda c: strip_numeric(c, keep_sign=True))
    assert kept == [-3.5, 5.0, None]


def test_nonfinite(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame(
        [(1, nan, [1.0, inf], (nan, "a")), (2, -inf, [nan], (2.0, "b")), (3, 4.0, None, None)],
        "id int, x double, xs array<double>, s struct<a: double, b: string>",
    )
    clean = {r["id"]: r for r in sanitize_nonfinite(df).collect()}
    assert clean[1]["x"] is None and clean[1]["xs"] == [1.0, None] and clean[1]["s"]["a"] is None
    assert clean[2]["x"] is None and clean[2]["xs"] == [None] and clean[2]["s"]["a"] == 2.0
    assert clean[3]["x"] == 4.0 and clean[3]["xs"] is None and clean[3]["s"] is None
    only_nan = {r["id"]: r["x"] for r in nullify(df).collect()}
    assert only_nan == {1: None, 2: -inf, 3: 4.0}


def test_text_helpers(spark):
    assert column(spark, ["sUM of Ab", "", None], capitalize) == ["Sum of ab", "", None]
    assert column(spark, [" \tNew  Land ", None], normalize_key) == ["new  land", None]
    paths = ["a.csv", "x/b.TXT", "p.b.jpeg", "q.png", "r.pdf", "s.xlsx", ".csv", "x/.png", "plain", "a.csv/b"]
    kinds = ["csv", "text", "image", "image", "pdf", "unknown", "unknown", "unknown", "unknown", "unknown"]
    assert column(spark, paths, classify_extension) == kinds
    dates = ["2024-01-02", "01/02/2024", "02-01-2024", "2024/01/02", "1/2/2024", "2024-01-02 ", None]
    assert column(spark, dates, is_date_text) == [True, True, True, False, False, False, None]


def test_headers_and_names(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, `b.c` int")
    assert trim_headers(df).columns == ["a", "b.c"]
    assert df.select(scalars.ref("b.c")).first()[0] == 2
    with pytest.raises(ValueError, match="no column"):
        scalars.field_type(df, "zzz")


def test_iso_text(spark):
    df = spark.sql("SELECT timestamp_micros(1) AS a, timestamp_micros(2000000) AS b")
    row = df.select(scalars.iso_text(F.col("a")), scalars.iso_text(F.col("b"))).first()
    assert tuple(row) == ("1970-01-01T00:00:00.000001", "1970-01-01T00:00:02")
    same = df.selectExpr(scalars.iso_sql("a"), scalars.iso_sql("b")).first()
    assert tuple(same) == tuple(row)
