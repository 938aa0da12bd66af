import os
import time

import numpy as np
import pyarrow as pa
import pytest

from tabscope.llm import common


def test_stored_tables_can_be_dropped(spark):
    table = common.stored(spark.range(5), "five")
    assert table.count() == 5
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert os.path.isdir(folder)
    common.drop_stored(spark)
    assert not os.path.exists(folder)


def test_stored_tables_leave_no_shuffle_files(spark):
    """A table of its own query: only what runs besides it may still have files."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    counted = spark.range(5000).selectExpr("id % 100 AS a").groupBy("a").count()

    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    old = files()
    table = common.stored(counted, "counted")
    for _ in range(50):
        new = files() - old
        if not new:
            break
        time.sleep(0.1)
    assert not new and table.count() == 100 and spark.conf.get(setting, None) == before
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    other = common.stored(table, "other")
    common.drop_tables(table)
    assert not os.path.exists(path) and other.count() == 100


def test_likely_rows_keep_all_wanted(spark):
    rows = spark.range(2000).selectExpr("IF(id = 7, NULL, id) AS k", "id AS other")
    wanted = spark.range(0, 2000, 100).selectExpr("IF(id = 700, NULL, id) AS id")
    kept = {r.k for r in common.likely_rows(rows, "k", wanted).collect()}
    assert {None, *(i for i in range(0, 2000, 100) if i != 700)} <= kept and len(kept) < 100


@pytest.mark.parametrize("text", ["", "a", "  a b\tc ", "A\x0bB\x0c", "é \x1c x\x85y", "x" * 5000])
def test_words(text):
    parts = [text, "one two", "", text]
    raw, offsets = common.text_buffers(pa.array([*parts, None]))
    hashes, bounds = common.word_hashes(raw, offsets)
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = [p.encode().translate(low).split() for p in parts]
    assert np.diff(bounds).tolist() == [*map(len, words), 0]
    seen = {}
    for word, value in zip((w for ws in words for w in ws), hashes.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_spans_hash_alike_wherever_they_stand():
    raw = np.frombuffer(b"abcXabcYabd", np.uint8)
    prefix = common.prefix_hashes(raw)
    a, b, c = common.span_hashes(prefix, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert a == b != c


def test_slices_where_arrays_are_wide():
    """Row ranges stay below the limit that is asked for; a longer row is taken alone."""
    texts = ["a" * 30] * 10 + ["b" * 500] + ["c" * 90, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [part.column(0).to_pylist() for part in common.batches_out([batch], lambda part: [part], 100)]
    assert [t for part in got for t in part] == texts
    assert all(sum(len(t or "") for t in part) <= 100 or len(part) == 1 for part in got)
