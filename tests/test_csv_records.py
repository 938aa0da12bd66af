import random

import numpy as np
import pytest

from tabscope.sources import csv_records, readers


@pytest.fixture
def small_blocks(spark):
    """Files in blocks of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "96", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(tmp_path, files, encoding="utf-8"):
    folder = tmp_path / "csv"
    folder.mkdir()
    for i, text in enumerate(files):
        (folder / f"f{i}.csv").write_bytes(text.encode(encoding))
    return str(folder)


def cell(rng):
    plain = rng.choice(["a", "b c", "12", "", 'mid"quote', "x" * 70, "é"])
    if rng.random() < 0.5:
        return plain
    inner = "".join(rng.choices(["a", ",", "\n", '""', " ", "é", "long " * 12, "\n\n"], k=rng.randrange(6)))
    return f'"{inner}"'


def made(rng, rows):
    return "id,a,b\n" + "".join(f"{i},{cell(rng)},{cell(rng)}\n" for i in range(rows))


@pytest.mark.parametrize("seed", range(4))
def test_same_rows_as_one_task_per_file(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    path = written(tmp_path, [made(rng, 40), made(rng, 1), "id,a,b\n", made(rng, 25).rstrip("\n")])
    want = sorted(map(tuple, readers.read_csv(spark, path, multi_line=True).collect()), key=repr)
    got = readers.read_csv(spark, path)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len(want) == 66
    records = csv_records.csv_records(spark, path, ",", "UTF-8")
    assert records.count() == 66 and csv_records._lines(spark, path, ",", "UTF-8").rdd.getNumPartitions() > 8


def test_one_record_over_many_blocks_and_order(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, of one cell" for i in range(60))
    path = written(tmp_path, [f'id,note\n1,"{long}"\n2,short\n3,"{long}\n"\n4,end\n'])
    got = readers.read_csv(spark, path, with_order=True).orderBy("_order")
    assert [(r.id, r.note) for r in got.collect()] == [(1, long), (2, "short"), (3, long + "\n"), (4, "end")]


def test_files_without_line_breaks_are_left_to_spark(spark, tmp_path, small_blocks):
    path = written(tmp_path, ['id,note\n1,"quoted, but whole"\n2,5" pipe\n3,"say ""yes"""\n'])
    assert csv_records.csv_records(spark, path, ",", "UTF-8") is None
    assert [r.note for r in readers.read_csv(spark, path).orderBy("id").collect()] == ["quoted, but whole", '5" pipe', 'say "yes"']


def test_line_ends_latin_1_empty_lines_and_wide_rows(spark, tmp_path, small_blocks):
    path = written(tmp_path, ['id;note\r\n1;"Grün\r\n\r\nü"\r\n\r\n2;x;too wide\r\n3;"a"\r\n'], "latin-1")
    rows = readers.read_csv(spark, path, sep=";").orderBy("id").collect()
    assert [(r.id, r.note) for r in rows] == [(1, "Grün\r\n\r\nü"), (3, "a")]


def test_a_quote_that_is_never_closed(spark, tmp_path, small_blocks):
    path = written(tmp_path, ['id,note\n1,"never closed\nat all\n'])
    assert readers.read_csv(spark, path).count() == 1


def test_lines_as_functions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        does = rng.integers(0, 4, rng.integers(1, 30)).astype(np.int8)
        for begins in (0, 1):
            state, want = begins, []
            for d in does.tolist():
                state = (d >> state) & 1
                want.append(state)
            assert csv_records.quoted_after(does, begins).tolist() == want


def test_what_a_line_does(spark):
    cases = {"a,b": 2, 'a,"b': 1, 'b",c': 0, '"a","b"': 0, '"a""': 1, 'a"b,c': 0, '""': 2, "": 2}
    lines = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r.line: r.does for r in lines.select("line", csv_records._function(lines["line"], ",").alias("does")).collect()}
    assert got == cases
