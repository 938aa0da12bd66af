import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabscope.llm import align
from tabscope.llm.bpe import byte_letters
from tabscope.llm.queries import aligned_tokens, read_table, tokenizer_path

PATHS = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def paths():
    return [tokenizer_path(p) for p in PATHS]


class Plain:
    """Whole texts by both libraries, groups and links from dictionaries of ends."""

    def __init__(self, paths):
        self.a = Tokenizer.from_file(paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        self.back = {c: b for b, c in enumerate(byte_letters())}

    def piece(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def __call__(self, text):
        if not text:
            return 0, 0, "", []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw_a = [bytes(self.back[c] for c in self.a.id_to_token(i)) for i in a]
        raw_b = [self.piece(i) for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return 0, 0, "", []
        ends = [dict(zip(np.cumsum([len(r) for r in raw]).tolist(), ids, strict=True)) for raw, ids in ((raw_a, a), (raw_b, b))]
        groups, links, before = [], [], 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            groups.append("|".join(",".join(str(i) for at, i in side.items() if before < at <= end) for side in ends))
            links.append((ends[0][end], ends[1][end]))
            before = end
        return len(a), len(b), ";".join(groups), links


def expected(rows, plain):
    made = [(i, *plain(t)) for i, t in rows]
    counts = Counter(link for r in made for link in r[4])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, n_a, n_b, groups, links in made:
        sums = len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((i, n_a, n_b, len(groups.split(";")) if groups else 0, *sums, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    rng = random.Random(1)
    parts = [" ", "  ", "a", "b", "the", "▁", "\n", "\t", "é", "\0", "ﬁ", "漢", "　", "\xa0", "é", "😀", "<s>", "</s>", "<unk>", "<0x41>"]
    parts += ["​", "﻿", "\r", "\x1f", "한", "가", ".", "<|endoftext|>", "'s", " the", "12", "\x85", "\x1c", "!", "!!", ";\r\n", "}\r"]
    rows = [None, "", " ", "\n", "a" * 3000, " " * 500, "word " * 2000, "x▁y", "ab\r\ncd\r \r\n e"]
    return rows + ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(1500)]


def test_same_as_whole_texts_by_the_libraries(spark, paths):
    rows = [*enumerate(texts()), (None, "no id"), (9, "again the same id")]
    docs = spark.createDataFrame([(i, t, [1], "x") for i, t in rows], "doc_id bigint, text string, links array<int>, key string")
    got = align.align_documents(docs, *paths).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, Plain(paths))
    assert align.align_documents(docs.limit(0), *paths).collect() == []


def test_whole_table(spark, sf, paths):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, aligned_tokens(spark, sf).select(COLUMNS).collect()), key=repr) == expected(rows, Plain(paths))


def test_groups_and_counts_as_tables(spark, paths):
    docs = spark.createDataFrame([("x", "the unbelievable the")], "doc_id string, text string")
    made = align.align(docs, *paths, groups=True)
    row, plain = made.first(), Plain(paths)("the unbelievable the")
    assert (row.doc_id, row.groups) == ("x", plain[2])
    counts = align.link_counts(made, 32000)
    assert {((r.a_id, r.b_id), r.n) for r in counts.collect()} == set(Counter(plain[3]).items())
    assert all(r.link == r.a_id * 32000 + r.b_id and r.best for r in counts.collect())


def test_few_kept_segments_give_the_same(paths, monkeypatch):
    want = list(align.Aligner(*paths).align(texts()))
    monkeypatch.setattr(align, "_KEPT_SEGMENTS", 5)
    monkeypatch.setattr(align, "_TOGETHER", 3)
    made = align.Aligner(*paths)
    assert [x for t in texts() for x in made.align([t])] == want
    monkeypatch.setattr(align, "_KEPT_SIZE", 0)
    assert list(align.Aligner(*paths).align(texts())) == want


def test_intervals():
    """Two sides that cut 0..6 into 2, 4 and into 1, 3, 2: one common end besides the last would be a break."""
    groups, pairs = align.coalesce(np.array([0, 2, 0, 1, 4]), np.array([2, 6, 1, 4, 6]), 2)
    assert groups.tolist() == [0, 0, 0, 0, 0]
    assert pairs.T.tolist() == [[0, 0], [0, 1], [1, 1], [1, 2]]
    groups, _ = align.coalesce(np.array([0, 2, 0, 1, 2]), np.array([2, 6, 1, 2, 6]), 2)
    assert groups.tolist() == [0, 1, 0, 0, 1]
