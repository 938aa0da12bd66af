import hashlib
import random

import numpy as np
import pyarrow as pa

from tabscope.llm import fingerprints
from tabscope.llm.common import byte_codes, read_table
from tests.llm.brute import SCHEMA, imatch


def check(docs, rows):
    words = fingerprints.lexicon(docs)
    got = fingerprints.compare_edited(docs, words).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    marks = fingerprints.fingerprints(pa.array([t or "" for _, t in order], pa.string()), words)
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, follows = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + follows[:half]
        mark = fingerprints.fingerprints(pa.array([new], pa.string()), words)[0]
        near = [float(fingerprints.likeness(marks[i : i + 1], m[None])[0]) for m in (mark, marks[(i + 1) % len(order)])]
        digest = hashlib.sha256(new.encode()).hexdigest()
        want.append((doc_id, len(text), digest, marks[i].astype(">u2").tobytes().hex(), mark.astype(">u2").tobytes().hex(), *near))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return got


def test_whole_table(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(docs, rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r.near_edited for r in got]) > 5 * np.mean([r.near_next for r in got])


def test_small_tables(spark):
    for rows in ([(1, "a b")], [(1, None), (2, ""), (7, "é" * 5), (None, "x y z")], [(5, "q"), (3, "long " * 50_000), (-4, "w")]):
        check(spark.createDataFrame([(i, t, "alt", "bucket", 0) for i, t in rows], SCHEMA).withColumnRenamed("lang", "key"), rows)
    none = spark.createDataFrame([], SCHEMA)
    assert fingerprints.compare_edited(none, fingerprints.lexicon(none)).count() == 0


def test_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "e f"), (2, "g h i")], "doc_id bigint, text string")
    got = fingerprints.compare_edited(docs, fingerprints.lexicon(docs)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    assert len({r.fingerprint for r in got if r.n_chars == 7}) == 1
    assert fingerprints.fingerprint_documents(docs, fingerprints.lexicon(docs)).count() == 4


def test_same_as_plain_counting(spark, sf):
    """Lexicon, subsets, hashes and likeness recomputed one word at a time."""
    docs = read_table(spark, sf, "documents")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    of = imatch(rows, byte_codes().tolist(), fingerprints.LOW, fingerprints.HIGH, fingerprints.SHARES)
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs, fingerprints.lexicon(docs)).collect()}

    def like(a, b):
        return sum(x == y > 0 for x, y in zip(a, b, strict=True)) / max(1, sum(x > 0 or y > 0 for x, y in zip(a, b, strict=True)))

    checked = 0
    for i in random.Random(1).sample(range(len(rows)), 60):
        doc_id, text = rows[i]
        follows = rows[(i + 1) % len(rows)][1] or ""
        half = len(text or "") // 2
        marks = [of(t) for t in (text, (text or "")[: len(text or "") - half] + follows[:half], follows)]
        if any(not any(m) for m in marks):
            continue  # named by a hash of all the text
        checked += 1
        r = got[doc_id]
        assert [r.fingerprint, r.edited_fingerprint] == ["".join(f"{x:04x}" for x in m) for m in marks[:2]]
        assert (r.near_edited, r.near_next) == (like(marks[0], marks[1]), like(marks[0], marks[2]))
    assert checked > 40
