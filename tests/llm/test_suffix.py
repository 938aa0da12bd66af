import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import suffix, suffix_dedup
from tests.llm.brute import SCHEMA, repeats, without


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_two_stage_order(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        text = rng.integers(0, letters, rng.integers(1, 80)).astype(np.uint8)
        wanted = rng.random(len(text)) < rng.random()
        raw = text.tobytes()
        assert suffix.suffix_order(text, wanted, 1000).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


def documents():
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh é", k=90))
    rows = [(i, "".join(rng.choices("abé", k=rng.randrange(150)))) for i in range(25)]
    rows += [(100 + i, "".join(rng.choices("xyz ", k=20)) + passage[: rng.randrange(5, 90)] + "".join(rng.choices("xyz ", k=20))) for i in range(20)]
    rows += [(200, None), (201, ""), (None, passage), (202, passage), (202, passage[3:50] + "é"), (202, passage), (203, "a" * 400), (204, "ab" * 3000)]
    return rows


@pytest.mark.parametrize("group", [suffix.GROUP, 1])
def test_same_bytes_as_counting_all_strings(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = documents()
    docs = spark.createDataFrame([(i, t, "anchor", None, 1) for i, t in rows], SCHEMA).withColumnRenamed("lang", "ranges").withColumnRenamed("source", "id")
    got = sorted(repr((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.removed], bytes(r.kept))) for r in suffix_dedup.remove_repeats(docs, 20, 8).collect())
    data = [(t or "").encode() for _, t in rows]
    spans = repeats(data, 20)
    assert got == sorted(repr((i, len(d), sum(b - a for a, b in s), s, without(d, s))) for (i, _), d, s in zip(rows, data, spans, strict=True))
    left = suffix_dedup.drop_repeats(docs, 20, 8)
    assert left.columns == docs.columns
    kept = [without(d, s).decode("utf-8", "ignore") if t is not None else None for (_, t), d, s in zip(rows, data, spans, strict=True)]
    assert sorted((repr(r.doc_id), repr(r.text)) for r in left.collect()) == sorted((repr(i), repr(t)) for (i, _), t in zip(rows, kept, strict=True))
    assert all(r.n_chars in (1, len(r.text or "")) for r in left.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert suffix_dedup.drop_repeats(docs).columns == docs.columns


def test_distinct_owners(spark):
    rows = spark.createDataFrame([(1, 0, b"abcdabcd"), (2, 0, b"xabcdx"), (3, 9, b"abcd"), (4, 0, b"pqpqpq")], "id bigint, seed bigint, data binary")
    got = {r.id: suffix.spans([x.asDict() for x in r.ranges], 99) for r in suffix.repeated_ranges(rows, 4, 2, 1, distinct=True).collect()}
    assert got == {1: [(0, 8)], 2: [(1, 5)]}


def test_rows_of_one_id_keep_their_own_ranges(spark):
    """Different texts of one id, equal in the lowest 20 bits of their hash: only the one with a repeat is cut."""
    made = spark.range(8000).selectExpr("sha2(cast(id AS string), 256) AS text").selectExpr("text", "xxhash64(cast(text AS binary)) & 1048575 AS low")
    pairs = made.groupBy("low").agg(F.collect_list("text").alias("texts")).filter("size(texts) > 1").orderBy("low").limit(3).collect()
    assert pairs
    for doc_id in (None, 7):
        rows = [(doc_id, t) for p in pairs for t in p.texts] + [(1, p.texts[0][10:50]) for p in pairs]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sorted((r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(docs, 20, 8).collect())
        cut = {p.texts[0] for p in pairs}
        want = [(64, 40, t[:10] + t[50:]) if t in cut else (64, 0, t) for i, t in rows if i == doc_id] + [(40, 40, "")] * len(pairs)
        assert got == sorted(want)


def test_copies_of_a_row_are_cut_once(spark, monkeypatch):
    sizes = []
    kept = suffix.stored
    monkeypatch.setattr(suffix, "stored", lambda df, name: (out := kept(df, name), sizes.append(out.count()) if name == "pieces" else None)[0])
    rng = random.Random(9)
    one, two = "".join(rng.choices("abcdefgh", k=80)), "".join(rng.choices("stuvwxyz", k=80))
    for copies in (2, 9):
        rows = [(1, 0, one.encode())] * copies + [(2, 0, (two + one[10:60]).encode())]
        found = suffix.repeated_ranges(spark.createDataFrame(rows, "id bigint, seed bigint, data binary"), 20, 8).collect()
        for r in found:
            assert len(r.ranges) == len({(x.first, x.symbols) for x in r.ranges})
        assert {r.id: suffix.spans([x.asDict() for x in r.ranges], 999) for r in found} == {1: [(0, 80)], 2: [(80, 130)]}
    assert sizes[0] == sizes[1] > 0


@pytest.mark.parametrize("size", [306, 363, 399, 400, 401, 480])
def test_planted_passages_go_from_400_bytes_on(spark, sf, size):
    """The same passage in two documents of the table, with different bytes around it, cut to a known number of bytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) > 50").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(size)
    passage = "".join(rng.choices("abcdefghij klmnop", k=size))
    planted = [(i, f"{t[: len(t) // 2]}{'<>'[k]}{passage}{'()'[k]}{t[len(t) // 2 :]}") for k, (i, t) in enumerate(rows[:2])]
    texts = spark.createDataFrame(planted + rows[2:], "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept).decode("utf-8", "replace") for r in suffix_dedup.remove_repeats(texts).collect()}
    for i, _ in planted:
        assert (passage in kept[i]) == (size < suffix_dedup.LENGTH)


def test_columns_of_any_name(spark):
    passage = "p" * 7 + "".join(random.Random(3).choices("abcdefgh", k=40))
    rows = [(1, "x" + passage, "a", 1), (1, "x" + passage, "a", 1), (2, None, "b", 2), (3, "y" * 3, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __ranges string, ranges int")
    got = suffix_dedup.drop_repeats(docs, 20, 8)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "", "a", 1), (1, "", "a", 1), *rows[2:]], key=str)
    assert suffix_dedup.drop_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [49, 50, 51, 58, 90])
def test_shared_passages_of_fifty_words_go(spark, size):
    """Short words, so that 58 of them stay below 400 bytes; other white space and case are no difference, copies of a row no repeat."""
    rng = random.Random(size)

    def words(n):
        return ["".join(rng.choices("abcdefghijkl", k=rng.randrange(3, 6))) for _ in range(n)]

    passage, alone = words(size), " ".join(words(70))
    spaced = "é\t" + "\n ".join(passage).upper() + " end"
    rows = [(i, " ".join([*words(20), *passage, *words(30)])) for i in range(3)]
    rows += [(7, spaced), (8, alone), (8, alone), (9, "la " * 60), (10, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in suffix_dedup.drop_repeats(docs, 10**4, 4000, words=50).collect()), key=str)
    want = []
    for i, t in rows:
        if size >= 50 and i < 3:
            t = t.replace(" ".join(passage), "")
        elif size >= 50 and i == 7:
            t = "é\t end"
        want.append((i, t, len(t or "")))
    assert got == sorted(want, key=str)
    if size < 60:
        assert sorted(((r.doc_id, r.text) for r in suffix_dedup.drop_repeats(docs).collect() if r.doc_id < 3), key=str) == rows[:3]


def test_anchors_that_stand_twice(spark, monkeypatch):
    rng = np.random.default_rng(3)
    anchors = rng.integers(-(1 << 63), 1 << 63, 3000)
    anchors = np.concatenate([anchors, anchors[:200], anchors[:50], [-1, -1, 0, 0, 0]])
    found = spark.createDataFrame([(int(a),) for a in anchors], "anchor bigint").repartition(5)
    want = {int(a) for a in (anchors[np.r_[0:200, -1, -5]].astype(np.int64).view(np.uint64) >> np.uint64(12))}
    for held in (suffix._HELD, 100):
        monkeypatch.setattr(suffix, "_HELD", held)
        assert sorted(r.key for r in suffix._twice(found).collect()) == sorted(want)
