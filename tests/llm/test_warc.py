import base64
import gzip
import hashlib
import os
from collections import defaultdict

import pytest

from tabscope.llm import warc
from tabscope.llm.common import stored_path

SCHEMA = "page_id bigint, url string, html string, key string, shard int, rank int"
ROWS = [
    (5, "http://a/1", "<p>same</p>"),
    (7, "http://a/2", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (None, "http://a/null", "<p>same</p>"),
    (7, "http://a/other of equal id", "<p>other é 😀</p>"),
    (8, "http://a/\r\nX-Evil: 1", None),
    (9, "", ""),
    (-4, "http://a/x", "long " * 50_000),
    (10, "http://a/copy", "twice"),
    (10, "http://a/copy", "twice"),
    (10, "http://a/copy", "twice"),
    (11, "http://a/end", "HTTP\r\n\r\nWARC/1.1\r\n\r\n"),
    (None, None, "alone"),
]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """Of rows that are all equal the first is a response."""
    groups, seen, out = defaultdict(list), set(), []
    for i, _, h in rows:
        groups[h or ""].append(-(1 << 70) if i is None else i)
    for i, u, h in rows:
        top = max(groups[h or ""])
        if len((h or "").encode()) < least:
            kind, to = "response", None
        elif (-(1 << 70) if i is None else i) == top and (i, u, h) not in seen:
            kind, to = "response", None
        else:
            kind, to = "revisit", top
        seen.add((i, u, h))
        out.append((i, len((h or "").encode()), sha1(h), kind, to))
    return sorted(out, key=repr)


def made(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 12, 10**9])
def test_round_trip(spark, least):
    path = stored_path(spark, "archive")
    manifest = warc.write_warc(made(spark), path, min_bytes=least, shard_bytes=1500, file_bytes=400)
    back = warc.read_warc(manifest, path)
    assert sorted(map(tuple, back.select(COLUMNS).collect()), key=repr) == expected(ROWS, least)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS) and manifest.count() > 3
    payloads = {(r.page_id, r.html) for r in back.collect() if r.record_type == "response"}
    assert (-4, "long " * 50_000) in payloads and (7, "<p>other é 😀</p>") in payloads
    assert "http://a/%0D%0AX-Evil:%201" in {r.url for r in back.collect()}


def files(path):
    return {n: open(f"{path}/{n}", "rb").read() for n in os.listdir(path) if n.endswith(".gz")}


def test_same_rows_same_files(spark):
    paths = [stored_path(spark, "archive") for _ in range(2)]
    made_in = [made(spark, ROWS), made(spark, ROWS[::-1]).repartition(5)]
    for path, rows in zip(paths, made_in, strict=True):
        warc.write_warc(rows, path, shard_bytes=1500, file_bytes=400)
    first, second = map(files, paths)
    assert first == second and len(first) > 3
    manifest = {r.file: r for r in warc.read_manifest(made_in[0], paths[0]).collect()}
    assert {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in first.items()} == {n: (r.bytes, r.sha256) for n, r in manifest.items()}
    assert not os.path.exists(f"{paths[0]}/_temporary")
    with pytest.raises(ValueError, match="holds an archive"):
        warc.write_warc(made_in[0], paths[0])


def test_damage_is_seen(spark):
    path = stored_path(spark, "archive")
    manifest = warc.write_warc(made(spark), path)
    name = manifest.first().file
    raw = gzip.decompress(open(f"{path}/{name}", "rb").read()).replace(b"other", b"OTHER")
    with open(f"{path}/{name}", "wb") as f:
        f.write(gzip.compress(raw))
    with pytest.raises(Exception, match="is damaged"):
        warc.read_warc(manifest, path).collect()


def test_ranges_in_order_and_no_pages(spark):
    path = stored_path(spark, "archive")
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(200)]
    manifest = warc.write_warc(made(spark, rows), path, shard_bytes=20_000, file_bytes=2_000).orderBy("file").collect()
    ends = [(r.first_page, r.last_page) for r in manifest]
    assert len(ends) > 5 and [p for r in ends for p in r] == sorted(p for r in ends for p in r)
    empty = stored_path(spark, "archive")
    manifest = warc.write_warc(made(spark).limit(0), empty)
    assert manifest.collect() == [] and warc.read_warc(manifest, empty).collect() == []
