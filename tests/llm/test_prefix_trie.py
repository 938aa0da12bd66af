import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tabscope.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, box string, key int"


def brute(rows, rebuild=True):
    """Nodes from dictionaries of whole beginnings."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            identity = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, identity, (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    if rebuild:
        heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - int(math.fmod(c, 5)), [])[: heads[c]] + ts[heads[c] :] for c, ts in own.items()}
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        here = members[path]
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(here) - 1) * (len(path[-1][1].encode()) if path else 0)
        ends = ",".join(str(c) for c in sorted(here) if len(own[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        row = (min(here), len(path), parent, len(here), len(kids[path]), leaves[path], saved[path])
        out.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)


def nodes(trie):
    return sorted(map(tuple, trie.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for conv in range(-7, 60):
        for k in range(rng.choice([0, 1, 2, 3, 12, 80])):
            role, texts = rng.choice([None, "user", "user"]), [None, "", "a", "é", "bb"] if k % 3 == 0 else ["x"]
            out.append((conv if rng.random() < 0.98 else None, rng.choice([None, k, k, 0]), role, rng.choice(texts)))
    return out + out[:5]


@pytest.mark.parametrize("limit", [512, 2, 1])
def test_any_container_size_gives_the_same_nodes(spark, rows, limit):
    """Nulls, ties, repeated rows, negative ids, turnless conversations, clashing column names; 1 and 2 burst at every depth."""
    assert nodes(prefix_trie.prefix_trie(prefix_trie.shared_heads(made(spark, rows)), limit)) == brute(rows)


def test_conversations_as_they_are(spark, rows):
    assert nodes(prefix_trie.prefix_trie(prefix_trie.sequences(made(spark, rows)), 3)) == brute(rows, rebuild=False)


def test_long_shared_beginnings_and_growing_snapshots(spark):
    """One burst looks 64 turns ahead; each snapshot ends where the next one goes on."""
    line = [(f"turn {i}",) for i in range(150)]
    rows = [(c, i, "user", t) for c in range(4) for i, (t,) in enumerate([*line, (f"own {c}",)])]
    rows += [(10 + c, i, "user", line[i][0]) for c in range(0, 150, 30) for i in range(c)]
    assert nodes(prefix_trie.prefix_trie(prefix_trie.sequences(made(spark, rows)), 2)) == brute(rows, rebuild=False)


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(1000, 0, "user", "other")]
    assert nodes(prefix_trie.prefix_trie(prefix_trie.sequences(made(spark, rows)))) == brute(rows, rebuild=False)


def test_nothing_gives_no_node(spark):
    empty = made(spark, [(1, 0, "user", "a")]).limit(0)
    assert prefix_trie.prefix_trie(prefix_trie.shared_heads(empty)).collect() == []
    no_ids = made(spark, [(None, 0, "user", "a")])
    assert prefix_trie.prefix_trie(prefix_trie.sequences(no_ids)).collect() == []
    # conversation 1 has one turn, its first ones come from conversation 0, which is not there
    assert nodes(prefix_trie.prefix_trie(prefix_trie.shared_heads(made(spark, [(1, 0, "u", "a")])))) == brute([(1, 0, "u", "a")])
