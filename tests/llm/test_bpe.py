import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tabscope.llm import bpe
from tabscope.llm.common import read_table
from tabscope.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x20, 0x7F)] + list("  \n\t\r\x0b\x1c\x85\xa0 　's'll éßÉ€😀՘₏Ᲊ")
    rows = [None, "", " ", "a" * 5000, "word " * 3000, "<|endoftext|>", "x<|endoftext|>\n<|endoftext|>y", "<|endoftext|", "naïve café", "日本語 テキスト"]
    return rows + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(400)]


def test_same_ids_and_text_as_the_library(spark, path):
    library = Tokenizer.from_file(path)
    rows = list(enumerate(texts())) + [(None, "null id"), (5, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, ids int")
    got = sorted(map(repr, map(tuple, bpe.round_trip(docs, path).collect())))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append(repr((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert got == sorted(want)
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_each_prefix_has_one_last_token(path):
    """Of all tokens that end a prefix, exactly one agrees with merging."""
    vocabulary = bpe.Vocabulary(path)
    for word in ("Ġunbelievable", "Ġthntblere", "aaaaaaaaab", "Ġ1234567"):
        encoded = {n: vocabulary.encode_word(word[:n]) for n in range(1, len(word) + 1)}
        for n in range(1, len(word) + 1):
            ends = []
            for token, i in vocabulary.ids.items():
                if word[:n].endswith(token) and vocabulary.sound(i):
                    rest = n - len(token)
                    if rest == 0 or vocabulary.fits(encoded[rest][-1], i):
                        ends.append(i)
            assert ends == [encoded[n][-1]]


def test_bytes_that_are_no_text(spark, path):
    rows = spark.createDataFrame([(1, [195]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: (r.ids, r.text) for r in bpe.decode(rows, path).collect()}
    assert got == {1: ([195], Tokenizer.from_file(path).decode([195])), 2: ([], ""), 3: ([], "")}


def test_whole_table(spark, sf, path):
    library = Tokenizer.from_file(path)
    docs = read_table(spark, sf, "documents")
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[r.doc_id] = (r.doc_id, len(ids), *digests)
    assert {r.doc_id: tuple(r) for r in bpe.round_trip(docs, path).collect()} == want
