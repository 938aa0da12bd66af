import os

import datetime

import pytest

from tabscope.operators import paging
from tabscope.sources.shared import fresh_path


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 1000, 1, 7).selectExpr("id", "id % 10 AS g", "CAST(id * 0.5 AS DOUBLE) AS x")


def test_slices_put_together_are_the_table(rows):
    whole = [r["id"] for r in rows.orderBy("g", "id").collect()]
    parts = []
    for page in range(1, 5):
        parts += [r["id"] for r in paging.page_slice(rows, ["g", "id"], page, 300).collect()]
    assert parts == whole
    assert paging.page_slice(rows, "id", 9, 300).count() == 0


def test_following_pages(rows):
    last, seen = None, []
    while True:
        page = paging.page_after(rows, ["g", "id"], last, 170).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        last = page[-1].asDict()
    assert seen == [r["id"] for r in rows.orderBy("g", "id").collect()]


def test_page_index(spark, rows):
    path = fresh_path(spark, "index")
    paging.write_page_index(rows, ["-x"], path)
    want = [r["id"] for r in rows.orderBy(rows["x"].desc()).collect()]
    got = []
    for page in range(1, 5):
        part = paging.read_page(spark, path, page, 300).orderBy("row_number").collect()
        got += [(r["row_number"], r["id"]) for r in part]
    assert got == list(enumerate(want, 1))


def test_deep_pages_write_nothing(spark, rows):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(folder.removeprefix("file:")))
    assert paging.page_slice(rows, "id", 2_000_002, 1).count() == 0
    assert set(os.listdir(folder.removeprefix("file:"))) == before
    deep = [r["id"] for r in paging.page_slice(rows, ["g", "-id"], 4, 150).collect()]
    assert deep == [r["id"] for r in rows.orderBy("g", rows["id"].desc()).collect()][450:600]


def test_info_and_list(spark, rows):
    info = paging.page_info(rows, 3, 400).first()
    assert (info["count"], info["total_pages"], info["next"], info["previous"]) == (1000, 3, False, True)
    assert [r["page"] for r in paging.page_list(rows, 400).collect()] == [1, 2, 3]
    assert [r["page"] for r in paging.page_list(rows.filter("id < 0")).collect()] == [1]
    assert paging.page_info(rows, 1, 5_000_000).first()["size"] == 5_000_000
    for bad in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            paging.page_info(rows, *bad)


def test_heads_and_sorting(rows):
    assert [r["id"] for r in paging.head_rows(rows, 3, "-id").collect()] == [999, 998, 997]
    assert paging.head_rows(rows, 0, "id").count() == 1000
    assert paging.list_sorted(rows, "-x").first()["id"] == 999
    assert dict(paging.floats_as_text(rows).dtypes)["x"] == "string"


@pytest.fixture(scope="module")
def files(spark):
    day = [datetime.datetime(2024, 1, d) for d in range(1, 8)]
    return spark.createDataFrame(
        [
            ("1", "p", "a.csv", "Sales.csv", "csv", day[0], False, False),
            ("2", "p", "b.csv", "sales.txt", "text", day[2], None, False),
            ("3", "p", "c.csv", "SALES2.csv", "csv", day[3], True, False),
            ("4", "q", "d.csv", "other.csv", "csv", day[4], False, True),
            ("5", "q", "p", "presales.csv", "csv", day[1], None, None),
        ],
        "_id string, project_id string, filename string, file string, type string, created_at timestamp,"
        " is_deleted boolean, is_sample boolean",
    )


def test_records(spark, files):
    def found(df):
        return [r["_id"] for r in df.collect()]

    assert found(paging.search_files(files, "sales")) == ["2", "5", "1"]
    assert found(paging.search_files(files, "SALES", "csv")) == ["5", "1"]
    assert sorted(found(paging.active(files))) == ["1", "2", "4", "5"]
    assert sorted(found(paging.files_of_project(files, "q"))) == ["4", "5"]
    projects = spark.createDataFrame([("p",), ("p",), ("z",)], "_id string")
    assert sorted(found(paging.files_of_projects(files, projects))) == ["1", "2", "3"]
    assert found(paging.find_record(files, "p", "1")) == ["1"]
    assert found(paging.find_record(files, "p", "d.csv")) == ["4"]
    assert found(paging.find_record(files, "p", "3")) == ["2"]  # deleted: falls back to the newest
    assert found(paging.find_record(files, "zz", "zz")) == []
    newest = {r["project_id"]: r["_id"] for r in paging.latest_per_key(files, "project_id", "created_at").collect()}
    assert newest == {"p": "3", "q": "4"}
    deleted = files.withColumnRenamed("created_at", "deleted_at").filter("_id = '1'")
    assert paging.active(deleted).count() == 0
