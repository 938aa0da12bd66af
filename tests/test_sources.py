import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabscope.operators import profile
from tabscope.plans import requests
from tabscope.sources import readers, writers
from tabscope.sources.html_tables import extract_html_tables, table_cells, table_rows, widen_table_cells
from tabscope.sources.shared import fresh_path


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tabscope-files-")


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(text)
    return path


RAGGED = 'a,b,c\n1,"x, y",2.5\n2,short\n3,too,4,long\n4,NA,\n5,"say ""hi""",-1e3\n'


def test_ragged_csv(spark, folder):
    df = readers.read_csv(spark, write(folder, "r.csv", RAGGED))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, "x, y", 2.5),
        (2, "short", None),
        (4, None, None),
        (5, 'say "hi"', -1000.0),
    ]
    # The row that is too long stays out even when only one column is asked for.
    assert df.select("a").count() == 4 and df.count() == 4


def test_missing_texts_differ_by_reader(spark, folder):
    path = write(folder, "m.csv", "a,b\nNA,1\nNULL,2\n,3\n")
    assert [r["a"] for r in readers.read_csv_for_profile(spark, path).orderBy("b").collect()] == ["NA", None, None]
    assert [r["a"] for r in readers.read_csv(spark, path).orderBy("b").collect()] == [None, None, None]


def test_types_and_order(spark, folder):
    text = "n,t,big,inf,none,mix,pad\n1,True,9223372036854775808,inf,,1, 7\n2,FALSE,2,1.5,,x, 8\n"
    df = readers.read_csv(spark, write(folder, "t.csv", text), with_order=True)
    types = dict(df.dtypes)
    assert (types["n"], types["t"], types["big"], types["inf"]) == ("bigint", "boolean", "double", "double")
    assert (types["none"], types["mix"], types["pad"]) == ("double", "string", "bigint")
    assert [r["n"] for r in df.orderBy("_order").collect()] == [1, 2]


def test_separators(spark, folder):
    semi = readers.read_csv_for_profile(spark, write(folder, "s.csv", "a;b\n1,5;2\n3;4\n"))
    assert semi.columns == ["a", "b"]
    for name, sep in (("tab.txt", "\t"), ("pipe.txt", "|"), ("semi.txt", ";"), ("comma.txt", ",")):
        text = "\n".join(sep.join(row) for row in (["a", "b", "c"], ["1", "2 x", "3"], ["4", "5", "6"]))
        df = readers.read_delimited(spark, write(folder, name, text + "\n"))
        assert df.columns == ["a", "b", "c"] and df.count() == 2
    assert readers.read_table(spark, os.path.join(folder, "pipe.txt")).columns == ["a", "b", "c"]
    assert readers.sniff_separator("only words\nhere\n") == ","


def test_encoding(spark, folder):
    df = readers.read_csv(spark, write(folder, "l.csv", "a\nGrün\n", "latin-1"), encoding="ISO-8859-1")
    assert df.first()["a"] == "Grün"


def test_json(spark, folder):
    document = write(folder, "d.json", '[{"k": "a", "v": 1.5},\n {"k": "b", "v": null}, {"k": "c"}]')
    assert [tuple(r) for r in readers.read_table(spark, document).orderBy("k").collect()] == [
        ("a", 1.5),
        ("b", None),
        ("c", None),
    ]
    lines = write(folder, "l.json", '{"k": "a", "v": 1}\n{"k": "b"}\n')
    assert readers.read_json_lines(spark, lines).count() == 2
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_table(spark, "x.xlsx")


def test_parquet_order(spark):
    path = fresh_path(spark, "order")
    spark.range(0, 100, 1, 3).write.parquet(path)
    ordered = readers.with_file_order(spark, path).orderBy("_order")
    assert [r["id"] for r in ordered.collect()] == list(range(100))


def test_cleansed_file(spark):
    df = spark.createDataFrame([(1, 'quo"te, x'), (2, None)], "a int, b string")
    path = fresh_path(spark, "csv")
    assert writers.write_cleansed(df, path) == 2
    assert [tuple(r) for r in readers.read_csv(spark, path).orderBy("a").collect()] == [(1, 'quo"te, x'), (2, None)]


def test_profile_store(spark):
    path = fresh_path(spark, "store")
    flat = profile.profile_counts(spark.range(3))
    writers.append_profile(flat, "f1", "p1", path)
    writers.append_profile(flat, "f2", "p1", path)
    assert writers.find_profiles(spark, path).count() == 2
    one = writers.find_profiles(spark, path, file_id="f2", project_id="p1").first()
    assert one["metadata"]["total_count"] == 3 and one["created_at"] is not None
    assert writers.profile_by_id(spark, path, one["_id"]).first()["file_id"] == "f2"
    assert writers.find_profiles(spark, path, project_id="p2").count() == 0


def test_cleanse_and_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "n int, s string")
    path = fresh_path(spark, "flow")
    assert requests.cleanse_and_profile(df, f"{path}/csv", f"{path}/store", file_id="f", project_id="p") == 2
    names = {r["metadata"]["name"] for r in writers.find_profiles(spark, f"{path}/store").collect()}
    assert names == {"n", "s"}
    details = requests.details_of(df, ["n", "s"], 1, 2, file_type="csv")
    assert details["rows"].count() == 2 and details["dataset_summary"].first()["total_rows"] == 4


PAGES = {
    1: "<table><tr><th>A</th><td>b</td></tr><tr></tr><tr><td> c&nbsp;</td></tr></table>"
    "<p>x</p><table></table><TABLE><TR><TD>d",
    2: "<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>end</td></tr></table>",
    3: "no tables, a < b",
    4: "<table><tr><td>a<script>var x = '<td>';</script><!-- <td>no --><td><b>b</b> c<tr><td>d</table>tail",
    5: None,
    6: "<table><tr><td>a<td>open to the end",
    7: "<!-- <table><tr><td>no</table> --><p title='</table'>x</p><table><tr><td title='<table>'>yes</table>rest",
    8: "<table title='<table>'><tr><td>quoted",
}


def test_html_rules():
    found = {p: list(table_rows(html)) for p, html in PAGES.items()}
    assert found[1] == [(0, 0, ["A", "b"]), (0, 1, ["c"]), (1, 0, ["d"])]
    assert found[2] == [(0, 0, ["outin", "in", "end"]), (0, 1, ["in"]), (1, 0, ["in"])]
    assert found[3] == [] and found[5] == []
    assert found[6] == [(0, 0, ["a", "open to the end"])] and found[7] == [(0, 0, ["yes"])]
    assert found[8] == [(0, 0, ["quoted"])]
    assert found[4] == [(0, 0, ["a", "b c"]), (0, 1, ["d"])]


def test_html_job(spark):
    pages = spark.createDataFrame([(p, "u", h) for p, h in PAGES.items()], "page_id long, url string, html string")
    rows = extract_html_tables(pages)
    got = {(r["page_id"], r["table_index"], r["row_index"]): r["cells"] for r in rows.collect()}
    assert got == {(p, t, i): cells for p, html in PAGES.items() for t, i, cells in table_rows(html)}
    wide = widen_table_cells(rows)
    assert wide.columns[3:] == ["c0", "c1", "c2"]
    assert wide.filter("page_id = 1 AND table_index = 1").first()["c1"] is None
    assert table_cells(rows).filter("page_id = 2").count() == 5
    path = fresh_path(spark, "tables")
    writers.write_tables(rows, path)
    stored = spark.read.csv(f"{path}/page_id=1/table_index=0").collect()
    assert [tuple(r)[:3] for r in stored] == [("0", "A", "b"), ("1", "c", None)]
    lines = [r[0] for r in spark.read.text(f"{path}/page_id=1/table_index=1").collect()]
    assert all(line.count(",") == 1 for line in lines)  # as wide as its own table
    writers.write_tables(rows, f"{path}-flat", folder_per_table=False)
    assert spark.read.csv(f"{path}-flat").count() == rows.count()


def test_pages_by_address(spark):
    pages = spark.createDataFrame([("http://a/?x=1", "<table><tr><td>1</table>"), (None, "<table><tr><td>2</table>")], "page_id string, html string")
    assert sorted(((r.page_id, r.cells) for r in extract_html_tables(pages).collect()), key=repr) == [("http://a/?x=1", ["1"]), (None, ["2"])]


def test_latin1_files(spark, folder):
    path = write(folder, "l.csv", "id,name\n1,Müller\n2,é\n", "latin-1")
    assert [r["name"] for r in readers.read_csv(spark, path).orderBy("id").collect()] == ["Müller", "é"]
    path = write(folder, "u.csv", "id;name\n1;Müller\n")
    assert readers.read_csv_for_profile(spark, path).first()["name"] == "Müller"


def test_cells_with_line_breaks(spark, folder):
    df = spark.createDataFrame([(1, "one\ntwo"), (2, 'say "x", y'), (3, "plain")], "id int, s string")
    writers.write_cleansed(df, f"{folder}/out")
    back = readers.read_csv_for_profile(spark, f"{folder}/out").orderBy("id")
    assert back.dtypes[0] == ("id", "bigint")
    assert [r["s"] for r in back.collect()] == ["one\ntwo", 'say "x", y', "plain"]


def test_many_rows_per_page(spark):
    cells = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12_000)), lambda i: F.concat(F.lit("<tr><td>"), i.cast("string"))), "")
    pages = spark.range(2).select(F.col("id").alias("page_id"), F.concat(F.lit("<table>"), cells).alias("html"))
    assert extract_html_tables(pages).count() == 24_000


def test_two_kinds_of_documents_in_one_store(spark):
    path = fresh_path(spark, "store")
    first = spark.createDataFrame([("a", 1, (1.5, None))], "column string, n bigint, more struct<mean:double,top:string>")
    second = spark.createDataFrame([("b", "x", ("y",))], "column string, n string, more struct<top:string>")
    writers.append_profile(first, "f1", "12", path)
    writers.append_profile(second, "f2", "a/b =", path)
    every = writers.find_profiles(spark, path)
    got = sorted((r["file_id"], r["project_id"], r["metadata"]["column"], r["metadata"]["n"], r["metadata"]["more"]["top"]) for r in every.collect())
    assert got == [("f1", "12", "a", "1", None), ("f2", "a/b =", "b", "x", "y")]
    one = writers.find_profiles(spark, path, project_id="12")
    assert one.first()["metadata"]["n"] == 1 and "PartitionFilters: [isnotnull(project_id" in one._jdf.queryExecution().executedPlan().toString()
    assert writers.find_profiles(spark, path, project_id="none").count() == 0
    assert set(spark.read.schema(writers._STORE).parquet(path).select(F.col("version")).distinct().collect()) == {(1,)}
