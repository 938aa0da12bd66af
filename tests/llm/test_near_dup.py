import random

import pytest

from tabscope.llm import near_dup
from tests.llm.brute import SCHEMA, components, shingles


def texts(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    base = [rng.choices(vocabulary, k=rng.randrange(3, 120)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "One\x0btwo"), (5, "one two three four"), (6, "one  TWO three four")]
    for w in base:
        for _ in range(rng.randrange(1, 9)):
            copy = list(w)
            for _ in range(rng.randrange(0, max(1, len(w) // 18) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 100, " ".join(copy)))
    rows.append((900, "x " * 30_000))
    rows.append((901, "X " * 30_000))
    return rows


@pytest.mark.parametrize("block", [near_dup.BLOCK, 2])
def test_same_components_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = texts()
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], SCHEMA).withColumnRenamed("lang", "node").withColumnRenamed("source", "bucket")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    want = components(rows)
    assert got == {i: (len(shingles(t)), want[i], want[i] == i) for i, t in rows}
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "q w e r t y"), (2, text), (3, "q w e r t y")], "doc_id bigint, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (1, 3, 1, True), (1, 3, 1, True), (1, 2, 1, True), (2, 3, 1, False), (3, 2, 1, False)], key=repr)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dup.keep_first(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
