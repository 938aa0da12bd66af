import random

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from tabscope.llm import suffix_dedup, toxicity
from tabscope.llm.common import read_table
from tests.llm.brute import SCHEMA, components, edit_distance, repeats, without


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, near copies, shared passages and benchmark passages; labels and a benchmark."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeiounrstl", k=rng.randrange(4, 9))) for _ in range(900)]

    def prose(n):
        return rng.choices(vocabulary, k=n)

    passage, item = " ".join(prose(80)), " ".join(prose(25))
    rows, labels = [], []
    for i in range(240):
        words = prose(rng.randrange(30, 120))
        if i % 6 == 0:
            words[5:5] = ["moronface", "scumbucket"]
        text = " ".join(words)
        if i % 20 == 1:
            text += " " + passage + " " + " ".join(prose(10))
        if i % 20 == 2:
            text += "\n" + item
        rows.append((i, text))
        if i < 200:
            labels.append((i, int(i % 2), int(i % 6 == 0)))
    rows += [(300 + n, rows[n * 7 + 3][1] + " " + " ".join(prose(3))) for n in range(20)]
    rows += [(400, None), (401, ""), (None, "null id " + " ".join(prose(20)))]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and registered.queries()["pipeline"] is corpus_pipeline.run
    docs = read_table(spark, folder, "documents")
    columns = docs.columns
    toxic, near, cut, bench, tokens = [f for _, f in corpus_pipeline.STAGES]

    left = toxic(spark, docs, folder)
    assert left.columns == columns
    kept = {r.doc_id: r.text for r in left.collect()}
    assert set(kept) == {r.doc_id for r in docs.collect() if not (r.doc_id is not None and "moronface" in (r.text or ""))}

    left = near(spark, left, folder)
    assert left.columns == columns
    want = components([(i, t) for i, t in kept.items() if i is not None])
    now = {r.doc_id: r.text for r in left.collect()}
    assert set(now) == {i for i in kept if i is None or want[i] == i}

    left = cut(spark, left, folder)
    assert left.columns == columns
    data = [(t or "").encode() for t in now.values()]
    spans = repeats(data, suffix_dedup.LENGTH)
    assert any(spans)
    shorter = {i: without(d, s).decode("utf-8", "ignore") if now[i] is not None else None for i, d, s in zip(now, data, spans, strict=True)}
    got = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert got == {i: (t, len(t or "")) for i, t in shorter.items()}

    left = bench(spark, left, folder)
    item = read_table(spark, folder, "benchmark").first().text
    clean = {i for i, t in shorter.items() if edit_distance(item, t or "") > len(item) // 20}
    assert left.columns == columns and {r.doc_id for r in left.collect()} == clean and len(clean) < len(shorter)

    out = {r.doc_id: r.n_tokens for r in tokens(spark, left, folder).collect()}
    assert set(out) == clean and all((n > 0) == bool(shorter[i]) for i, n in out.items())
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()} == out


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read_table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labels_that_are_never_learnt(spark, folder):
    from tabscope.llm.queries import learnt_labels

    import zlib

    ids = {r.doc_id for r in learnt_labels(spark, folder).collect()}
    assert ids == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert isinstance(toxicity.fit_on(read_table(spark, folder, "documents"), learnt_labels(spark, folder)), toxicity.ToxicityModel)


def test_passages_of_more_than_fifty_words(spark, folder):
    """Passages of 55 words below 400 bytes, in two documents each, are cut out; documents without one stay as they are."""
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choices("aeiounrstl", k=rng.randrange(4, 7))) for _ in range(n))

    passages = [prose(55) for _ in range(4)]
    rows = [(i, f"{prose(70)} {passages[i % 4]} {prose(40)}" if i < 8 else prose(120)) for i in range(16)]
    assert all(len(p) < suffix_dedup.LENGTH for p in passages)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, folder).collect()}
    assert got == {i: t.replace(passages[i % 4], "") for i, t in rows}
