import random

from tabscope.llm import decontaminate
from tests.llm.brute import SCHEMA, edit_distance

RNG = random.Random(4)
ITEMS = ["".join(RNG.choices("abcdefghij ", k=n)) for n in (40, 75, 130, 200)]


def edited(text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = RNG.randrange(len(out)), RNG.randrange(3)
        if kind == 0:
            out[at] = "z"
        elif kind == 1:
            out.insert(at, "y")
        else:
            del out[at]
    return "".join(out)


def test_bit_parallel_distance():
    for _ in range(200):
        pattern, text = "".join(RNG.choices("ab", k=RNG.randrange(1, 30))), "".join(RNG.choices("ab", k=RNG.randrange(60)))
        assert decontaminate.best_match(pattern, text)[0] == edit_distance(pattern, text)


def test_same_passages_as_the_full_table(spark, monkeypatch):
    rows = [(0, None), (1, ""), (2, "q" * 500)]
    for i in range(60):
        item = ITEMS[i % 4]
        rows.append((10 + i, "".join(RNG.choices("klmn ", k=30)) + edited(item, RNG.randrange(0, 2 + len(item) // 15)).upper() + "\n" + "".join(RNG.choices("klmn ", k=30))))
    rows += [(None, ITEMS[0]), (7, ITEMS[1]), (7, ITEMS[1])]
    docs = spark.createDataFrame([(i, t, None, "s", 2) for i, t in rows], SCHEMA).withColumnRenamed("lang", "item_id")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)] + [(9, None), (8, "")], "item_id int, text string")
    for size in (decontaminate.SLICE_CHARS, 100):
        monkeypatch.setattr(decontaminate, "SLICE_CHARS", size)
        got = sorted(repr((r.doc_id, r.item_id, r.distance, r.edits)) for r in decontaminate.find_passages(docs, bench).collect())
        want = []
        for i, t in rows:
            for n, item in enumerate(ITEMS):
                distance = edit_distance(decontaminate.normalized(item), decontaminate.normalized(t or ""))
                if distance <= len(item) // 20:
                    want.append(repr((i, n, distance, len(item) // 20)))
        assert got == sorted(want)
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    hit = {w.split(",")[0][1:] for w in want}
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(i) for i, _ in rows if repr(i) not in hit)


def test_places_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "...  " + ITEMS[0] + "  ...")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("a", ITEMS[0])], "item_id string, text string")
    row = decontaminate.find_passages(docs, bench).first()
    assert (row.item_id, row.distance, row.start, row.end) == ("a", 0, 5, 5 + len(ITEMS[0]))
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_passages(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 1
