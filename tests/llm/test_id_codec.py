import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabscope.llm import id_codec
from tabscope.llm.queries import tokenizer_path


@pytest.mark.parametrize("size", [0, 1, 255, 3000])
@pytest.mark.parametrize("vocabulary", [2, 16, 49408, 70000, 1 << 32])
def test_round_trip(size, vocabulary):
    rng = np.random.default_rng(size)
    skewed = (rng.pareto(1.0, size) * 20).astype(np.int64) % vocabulary
    for ids in (skewed.astype(np.uint32), np.full(size, vocabulary - 1, np.uint32)):
        frame = id_codec.pack(ids, vocabulary)
        assert np.array_equal(id_codec.unpack(frame), ids)


def test_predictions_pay():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49408, 40)
    ids = np.tile(phrase, 200).astype(np.uint32)
    assert len(id_codec.pack(ids, 49408)) * 8 / len(ids) < 6 < 12 < len(id_codec.pack(rng.integers(0, 49408, 8000).astype(np.uint32), 49408)) * 8 / 8000


def test_damage_is_noticed():
    frame = bytearray(id_codec.pack(np.arange(2000, dtype=np.uint32), 49408))
    frame[-700] ^= 1
    with pytest.raises(ValueError):
        id_codec.unpack(bytes(frame))
    with pytest.raises(ValueError):
        id_codec.unpack(b"something else")


def test_blocks_are_independent():
    ids = np.arange(3000, dtype=np.uint32)
    frame = id_codec.pack(ids, 4096)
    assert len(id_codec.encode_blocks([ids[:256]], 12)[0]) == len(id_codec.encode_blocks([ids[:256], ids[256:512]], 12)[0])
    assert np.array_equal(id_codec.unpack(frame), ids)


def test_documents_in_order(spark, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = [chr(i) for i in range(0x20, 0x17F)] + list("   \n\t'sst日本Σİß😀é")
    rows = [(i * 3 % 101 - 20, "".join(rng.choices(letters, k=rng.randrange(80)))) for i in range(100)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|>x<|startoftext|>"), (503, "word " * 4000), (None, "first")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, part int")
    frames = id_codec.write_ids(docs, path, 2)
    got = [tuple(r) for r in id_codec.with_checksums(id_codec.read_documents(frames)).collect()]
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert id_codec.read_documents(id_codec.write_ids(docs.limit(0), path, 2)).count() == 0


def test_starts_over_many_frames(spark, monkeypatch):
    monkeypatch.setattr(id_codec, "FRAME", 40)
    docs = spark.createDataFrame([(i, "some words " * (i % 7)) for i in range(120)], "doc_id bigint, text string")
    frames = id_codec.write_ids(docs, tokenizer_path("word_bpe_49k.json"), 2)
    assert frames.count() > 20
    at = 0
    for r in id_codec.read_documents(frames).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert at == sum(len("some words".split()) * (i % 7) + 1 for i in range(120))


def test_repeated_ids(spark):
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(5, "one text"), (5, "another text of it"), (5, "one text"), (None, "a"), (None, "a"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = id_codec.with_checksums(id_codec.read_documents(id_codec.write_ids(docs, path, 2))).orderBy("start").collect()
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got] == [None, None, 4, 4, 5, 5, 5]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
