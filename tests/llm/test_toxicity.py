import random

import zstandard

from tabscope.llm import toxicity
from tests.llm.brute import SCHEMA

BAD = ["grobian", "nitwit", "dolt", "oaf"]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioutnrsldm", k=rng.randrange(3, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(20, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(None, 1), (3, None), (1, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit_on(docs, labels)
    got = {r.doc_id: (r.score, r.toxic) for r in toxicity.score_documents(docs, model).collect()}
    held = [(got[i][1], y) for i, _, y in rows if i >= 300]
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 and (s >= 0.3) == p for s, p in got.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, p) in got.items() if not p}


def test_order_of_the_sample_does_not_matter():
    rows = [(t, y) for _, t, y in corpus(80, 2)]
    one, two = toxicity.fit(rows), toxicity.fit(rows[::-1])
    assert (one.toxic, one.ordinary, one.threshold) == (two.toxic, two.ordinary, two.threshold)


def test_whole_text_counts():
    model = toxicity.fit([(t, y) for _, t, y in corpus(200, 3)])
    assert model.distance("lorem " * 50_000 + "nitwit") == model.distance("nitwit") > model.threshold


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_on(docs, labels)
    assert [(r.distance, r.toxic) for r in toxicity.score_documents(docs, model).collect()] == [(0.0, False)] * 3
    assert toxicity.drop_toxic(docs, model).count() == 3
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def plain_length(dictionary, window):
    """Length of a window behind a dictionary, by a compressor of its own."""
    kept = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=kept).compress(window))


def test_distances_are_differences_of_lengths():
    """The distance of every text, window by window, from both compressed lengths."""
    rows = corpus(200, 5)
    model = toxicity.fit([(t, y) for _, t, y in rows])
    assert model.toxic and model.ordinary
    for _, text, _ in rows[:25]:
        most = 0.0
        for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            for n in (4, 5, 6, 8, len(word)):
                window = ((word[:n] + " ") * 4).encode()
                size = plain_length(model.toxic, window)
                if len(word) >= 4 and size <= model.length:
                    most = max(most, (plain_length(model.ordinary, window) - size) * 4 / len(window))
        assert model.distance(text) == most


def test_equal_scores_and_repeated_rows(spark):
    """Rows stand alone; a score at the cut is rejected; columns of any name stay."""
    model = toxicity.fit([(t, y) for _, t, y in corpus(200, 6)])
    text = corpus(200, 6)[0][1]
    model.threshold = model.distance(text)
    assert model.score(model.threshold) == toxicity.CUT
    rows = [(1, text, 0.5), (1, text, 0.5), (None, text, 0.1), (2, "", 0.2), (2, "", 0.2), (3, None, 0.3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    got = [(r.doc_id, r.toxic) for r in toxicity.score_documents(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (1, True), (None, True), (2, False), (2, False), (3, False)], key=str)
    kept = toxicity.drop_toxic(docs, model)
    assert sorted(map(tuple, kept.collect()), key=str) == [(2, "", 0.2), (2, "", 0.2), (3, None, 0.3)]
