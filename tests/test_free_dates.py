import datetime

from pyspark.sql import functions as F

from tabscope.functions.free_dates import free_date_sql
from tabscope.operators import profile, roles

READ = {
    "2024-2-13": "2024-02-13 00:00:00",
    "2024/02/13": "2024-02-13 00:00:00",
    "20240213": "2024-02-13 00:00:00",
    "2/13/2024": "2024-02-13 00:00:00",
    "2.3.24": "2024-02-03 00:00:00",
    " 13th of  February 2024 ": "2024-02-13 00:00:00",
    "13-Feb-69": "1969-02-13 00:00:00",
    "13FEB2068": "2068-02-13 00:00:00",
    "Feb. 13, 2024": "2024-02-13 00:00:00",
    "TUESDAY, february 13th, 2024 at 3:05 PM": "2024-02-13 15:05:00",
    "2024 Feb 13": "2024-02-13 00:00:00",
    "Sept 2024": "2024-09-01 00:00:00",
    "2024-02-13T10:11:12.5Z": "2024-02-13 10:11:12.500000",
    "2024-02-13 10:11+0200": "2024-02-13 08:11:00",
    "13 Feb 2024 12 am": "2024-02-13 00:00:00",
    "13 Feb 2024 12:30pm UTC": "2024-02-13 12:30:00",
    "June 5th,2024 23:59:59": "2024-06-05 23:59:59",
    "29 Feb 2024": "2024-02-29 00:00:00",
}
REFUSED = ["", "12 am", "Feb 30, 2024", "29 Feb 2023", "2024-13-01", "hello 12", "13 Feb 2024 25:00", "31/31/2024", "May 5 2024 13 pm", "2024-02/13"]
REFUSED += ["13/2/2024", "13 Feb 2024 7", "1234", "2024", "Febuary 3, 2024", "13 Feb 2024 10:11 +5", "x 13 Feb 2024", None]


def test_grammar(spark):
    texts = spark.createDataFrame([(t,) for t in [*READ, *REFUSED]], "x string")
    got = {r.x: str(r.t) if r.t else None for r in texts.select("x", F.expr(free_date_sql("x")).alias("t")).collect()}
    assert got == READ | dict.fromkeys(REFUSED)
    turned = {r.x: r.t for r in texts.select("x", F.expr(free_date_sql("x", day_first=True)).alias("t")).collect()}
    assert turned["13/2/2024"] == datetime.datetime(2024, 2, 13) and turned["2.3.24"] == datetime.datetime(2024, 3, 2)
    assert turned["2/13/2024"] is None and turned["2024-2-13"] == datetime.datetime(2024, 2, 13)


def test_mixed_columns_are_dates_and_others_are_not(spark):
    rows = [("2024-01-02", "2024-01-02", "31/12/24", "1"), ("3 March 2024", "Q2 2024", "May 1, 2024", "2"), (None, "2024-01-02", None, "3")]
    df = spark.createDataFrame(rows, "mixed string, words string, days string, id string")
    assert roles.date_formats(df) == {"mixed": "free", "days": "free, day first"}
    assert [r["column"] for r in roles.date_columns(df).collect()] == ["mixed", "days"]
    assert roles.is_date_column(df, "mixed") and not roles.is_date_column(df, "words")
    parsed = roles.parse_dates(df, {"mixed": "free"}).filter("id = 2").first()
    assert parsed["mixed"] == datetime.datetime(2024, 3, 3)
    kinds = {r["column"]: r["type"] for r in profile.profile(df).collect()}
    assert kinds == {"mixed": "DATE_TIME", "days": "DATE_TIME", "words": "STRING", "id": "STRING"}
