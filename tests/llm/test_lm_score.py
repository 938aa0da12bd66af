import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabscope.llm import common, lm_score
from tabscope.llm.common import read_table
from tests.llm.brute import SCHEMA, backoff_scores


@pytest.mark.parametrize("rare", [0.0, 1e-5, 0.01])
def test_same_scores_as_plain_counts(spark, rare):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "of", "cat", "Dog", "x1", f"w{i}"], k=rng.randrange(40)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "the " * 9000), (None, "cat of")]
    docs = spark.createDataFrame([(i, t, "gram", "n", 3) for i, t in rows], SCHEMA).withColumnRenamed("lang", "gram").withColumnRenamed("source", "n")
    got = {r.doc_id: r for r in lm_score.score_documents(docs, rare).collect()}
    want = backoff_scores(rows, rare, lm_score.BACKOFF)
    assert set(got) == set(want)
    for i, (n, score) in want.items():
        assert got[i].n_words == n and got[i].log_score == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert got[i].mean_log == (pytest.approx(score / n) if n else None)


def test_whole_table(spark, sf):
    docs = read_table(spark, sf, "documents")
    want = backoff_scores([(r.doc_id, r.text) for r in docs.collect()], lm_score.RARE, lm_score.BACKOFF)
    for r in lm_score.score_documents(docs).collect():
        assert (r.n_words, r.log_score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], rel=1e-9))


def test_unseen_words_rank_below_the_median(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    rng = random.Random(8)
    invented = [(-k, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(200))) for k in (1, 2, 3)]
    scores = lm_score.score_documents(docs.union(spark.createDataFrame(invented, docs.schema))).filter("n_words >= 50").collect()
    known = sorted(r.mean_log for r in scores if r.doc_id >= 0)
    assert max(r.mean_log for r in scores if r.doc_id < 0) < known[len(known) // 2]


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words) for r in lm_score.score_documents(docs).collect())
    assert got == [(1, 4), (1, 4), (2, 2)]
    assert lm_score.score_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [lm_score.FREQUENT, 0.02, 2])
def test_every_word_counts_as_itself(spark, monkeypatch, frequent):
    """Without a cut, words that occur once are words of their own, and no run of unseen words scores like a known one."""
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["the", "of", "cat", f"w{i}", f"w{i + 1}"], k=rng.randrange(40)))) for i in range(40)]
    rows += [(100, " ".join(f"once{i}" for i in range(30))), (101, None), (102, "cat of cat")]
    tokens = [t.split() for _, t in rows if t]
    one = Counter(w for ws in tokens for w in ws) + Counter({None: sum(1 for ws in tokens if ws)})
    two = Counter(g for ws in tokens for g in zip([None, *ws], ws, strict=False))
    total = sum(len(ws) for ws in tokens)
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 0).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        ws, score = (text or "").split(), 0.0
        for (v, w), n in Counter(zip([None, *ws], ws, strict=False)).items():
            others = two[v, w] - n
            score += n * math.log(others / one[v] if others else lm_score.BACKOFF * one[w] / total)
        assert (got[i].n_words, got[i].log_score) == (len(ws), pytest.approx(score, rel=1e-9, abs=1e-9))
    assert got[100].mean_log == pytest.approx(math.log(lm_score.BACKOFF / total))


def test_bigrams_take_little_room_on_the_way(spark, monkeypatch):
    """All shuffle files together, also those that go with their query, against the number of words."""
    monkeypatch.setattr(common, "_NO_LEFTOVERS", "spark.tabscope.files.stay")
    rng = random.Random(9)
    known = [f"word{i}" for i in range(20000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(known, k=500))) for i in range(400)], "doc_id bigint, text string")

    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}

    old = files()
    assert lm_score.score_documents(docs).agg({"n_words": "sum"}).first()[0] == 200_000
    assert sum(os.path.getsize(f) for f in files() - old) < 30 * 200_000


def test_equal_hashes_are_told_apart_by_their_other_bits(spark):
    keys = np.array([5, 5, 5, 1 << 63, (1 << 64) - 1], np.uint64)
    one = lm_score._packets(1, keys, np.array([7, 8, 9, 1, 1], np.uint64), np.array([10, 20, 30, 40, 700]), 3)
    two = lm_score._packets(2, keys[[0, 0, 3]], np.array([8, 7, 2], np.uint64), np.array([1, 2, 3]), 3)
    table = lm_score._packets(None, keys[-1:], np.array([1], np.uint64), np.array([5]), 3)
    asked = spark.createDataFrame([tuple(r.values()) for b in (one, two, table) for r in b.to_pylist()], lm_score._PACKET)
    got = lm_score.gram_answers(asked, 3).collect()
    others = {n: [] for n in (1, 2)}
    for r in sorted(got, key=lambda r: r.part):
        others[r.slice] += lm_score.from_planes(pa.array([bytes(r.others)]), np.array([r.n])).tolist()
    assert others == {1: [2, 1, 0, 0, 5], 2: [20, 10, 0]}


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_packets_give_back_what_they_got(parts):
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 64, 700, np.uint64, endpoint=False))
    keys[[0, -1]] = 0, (1 << 64) - 1
    counts = rng.integers(0, 1 << 20, 700)
    batch = lm_score._packets(4, keys, counts, counts, parts)
    sizes, begins = batch["n"].to_numpy().astype(np.int64), lm_score.part_starts(parts)
    gaps = np.split(lm_score.from_planes(batch["keys"], sizes), np.cumsum(sizes)[:-1])
    back = np.concatenate([begins[p] + np.cumsum(g) for p, g in zip(batch["part"].to_pylist(), gaps, strict=True)])
    assert (back == keys).all() and (lm_score.from_planes(batch["counts"], sizes) == counts).all()
    assert (lm_score.unpacked(lm_score.packed(keys), 700) == keys).all()


@pytest.mark.parametrize("size", [1, 50])
def test_scores_do_not_depend_on_slices_and_parts(spark, monkeypatch, size):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(["the", "of", "cat", f"w{i}", f"w{i % 7}"], k=rng.randrange(40)))) for i in range(60)]
    monkeypatch.setattr(lm_score, "SLICE_WORDS", size)
    monkeypatch.setattr(lm_score, "PART_WORDS", size)
    # One Arrow batch of a partition makes several slices only if it is cut.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i, (n, score) in backoff_scores(rows, 0.0, lm_score.BACKOFF).items():
        assert (got[i].n_words, got[i].log_score) == (n, pytest.approx(score, rel=1e-9, abs=1e-9))
