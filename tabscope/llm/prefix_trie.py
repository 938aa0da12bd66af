"""A trie over conversations: which beginnings they share, and how many bytes are saved where each is kept once.

A turn becomes a 128-bit id of its role and text, a conversation the sequence of its ids. Equal sequences are merged with
a count first. The trie is a burst trie: sequences start in containers by their first turn; a container of more than
``LIMIT`` distinct sequences bursts, which makes what all of it share heads of the trie and deals its suffixes to new
containers by the next turn id. The containers that remain lie in shards of Spark, each sorted; one sweep over the sorted
suffixes, with the open path as its only memory, gives their nodes. Heads are then summed up from the containers below
them, deepest first.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import batch_of, join_hot, map_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct sequences of a container at most; more make it burst.
LIMIT = 512
#: Bytes of a turn's id, and turns that one burst looks ahead for what its container shares.
_ID, _AHEAD = 16, 64
#: Ids of conversations that are written out together.
_CHUNK = 8192
_EMPTY = hashlib.sha256(b"").hexdigest()
#: Rows of nodes in a batch.
_ROWS = 5_000


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    identity = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    turn = F.struct("turn", identity.alias("id"), F.octet_length("text").alias("size")).alias("one")
    return rows.filter(F.col("conv_id").isNotNull()).select("conv_id", turn)


def _packed(turns: Column) -> list[Column]:
    ids = F.unhex(F.array_join(F.transform(turns, lambda t: t["id"]), ""))
    return [ids.alias("seq"), F.transform(turns, lambda t: t["size"]).alias("sizes")]


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, seq, sizes)``: the turns of each conversation in order, as joined 128-bit ids and as bytes of text.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``. Turns are ordered by ``turn``, NULL first, equal
    ones by their id; NULL roles and texts are empty; repeated rows are turns of their own; rows without ``conv_id``
    belong to no conversation. One conversation becomes one row of 20 bytes a turn.
    """
    grouped = _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return grouped.select("conv_id", *_packed(F.col("turns")))


def shared_heads(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """:func:`sequences` of rebuilt conversations that begin like the first of their group.

    Conversation ``c`` gets the first ``h`` turns of conversation ``c - c % group`` (as many as it has; none if there is
    none) and then its own turns after its first ``h``; ``h`` is the CRC-32 of its id in decimal, modulo ``most``.
    """
    turns = _turns(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    # One exchange: what lies together by base lies together by base and conversation too.
    each = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    groups = each.groupBy("base").agg(F.collect_list(F.struct("conv_id", "turns")).alias("convs"))
    first = F.get(F.filter("convs", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["turns"]
    kind = each.schema["turns"].dataType.simpleString()
    rows = groups.select(F.coalesce(first, F.array().cast(kind)).alias("first"), F.explode("convs").alias("c"))
    h = F.pmod(F.crc32(F.col("c.conv_id").cast("string")), F.lit(most)).cast("int")
    rows = rows.select("first", F.col("c.conv_id").alias("conv_id"), F.col("c.turns").alias("own"), h.alias("h"))
    rebuilt = F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return rows.select("conv_id", rebuilt.alias("turns")).select("conv_id", *_packed(F.col("turns")))


def ends_of(members: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: SHA-256 of the ids of all rows of a key, decimal, ascending, joined by commas.

    Ids are written out by many tasks, also those of one key; the digest itself reads a key's pieces in order.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, int, str]] = []
            key, begin, ids = None, 0, []
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or len(ids) == _CHUNK:
                    if ids:
                        found.append((key, begin, ",".join(ids)))
                    key, begin, ids = k, i, []
                ids.append(str(i))
            if ids:
                found.append((key, begin, ",".join(ids)))
            if found:
                keys, begins, texts = zip(*found, strict=True)
                yield batch_of(key=pa.array(keys, pa.binary()), begin=pa.array(begins, pa.int64()), ids=pa.array(texts, pa.string()))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield batch_of(key=pa.array([d[0] for d in done], pa.binary()), ends_sha256=pa.array([d[1] for d in done], pa.string()))
        if key is not None:
            yield batch_of(key=pa.array([key], pa.binary()), ends_sha256=pa.array([digest.hexdigest()], pa.string()))

    ordered = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    written = map_batches(ordered, pieces, "key binary, begin bigint, ids string")
    return map_batches(written.repartition("key").sortWithinPartitions("key", "begin"), digests, "key binary, ends_sha256 string")


def _common(a: bytes, b: bytes) -> int:
    """Turns that both sequences begin with."""
    low, high = 0, min(len(a), len(b)) // _ID
    while low < high:
        middle = (low + high + 1) // 2
        if a[_ID * low : _ID * middle] == b[_ID * low : _ID * middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    """An open node of the path: what is below it so far, and its closed children, who wait for its smallest member."""

    __slots__ = ("children", "conv", "depth", "ends", "kids", "leaves", "n", "saved", "size")

    def __init__(self, depth: int, size: int) -> None:
        self.depth, self.size, self.conv = depth, size, None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: str = _EMPTY
        self.kids: list[tuple] = []

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


_NODE = "box binary, parent binary, level int, top boolean, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
_NODE += "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_KINDS = [pa.binary(), pa.binary(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.string()]


def _swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers from their sequences, sorted by container and sequence."""
    rows: list[tuple] = []
    path: list[_Node] = []
    now: tuple = ()

    def close() -> None:
        node = path.pop()
        if not node.children:
            node.leaves = 1
        node.saved += (node.n - 1) * node.size
        rows.extend((*now, False, k[0], k[1], node.conv, *k[2:]) for k in node.kids)
        values = (node.depth, node.conv, node.n, node.children, node.leaves, node.saved, node.ends)
        if path:
            up = path[-1]
            up.add(node.n, node.conv)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.kids.append(values)
        else:
            rows.append((*now, True, *values[:2], None, *values[2:]))

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), _ROWS):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + _ROWS], strict=True), _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[p.split(" ")[0] for p in _NODE.split(", ")])
        rows.clear()

    last = b""
    for batch in batches:
        for box, parent, level, depth, seq, sizes, n, conv, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now and box == now[0]:
                common = _common(last, seq)
                while path[-1].depth > common:
                    close()
            else:
                while path:
                    close()
                now, common = (box, parent, level), depth - 1
            path.extend(_Node(d, sizes[d - 1]) for d in range(common + 1, len(sizes) + 1))
            path[-1].add(n, conv)
            path[-1].ends = ends
            last = seq
            if len(rows) >= _ROWS:
                yield from out()
    while path:
        close()
    yield from out()


def _from(seq: str, depth: str) -> Column:
    """What follows the first ``depth`` turns, as far as one burst looks."""
    return F.expr(f"substring({seq}, {_ID} * {depth} + 1, {_ID * _AHEAD})")


def _box(depth: str) -> Column:
    return F.unhex(F.md5(F.expr(f"substring(seq, 1, {_ID} * ({depth}))")))


def _burst(distinct: DataFrame, limit: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The containers' sequences, and for each round of bursting the heads and the sequences that end at one."""
    root = F.unhex(F.md5(F.lit("")))
    inside = distinct.filter(F.length("seq") > 0).withColumns({"level": F.lit(1), "depth": F.lit(1), "parent": root})
    inside = inside.withColumn("box", _box("1"))
    kept, rounds = [], []
    while True:
        ahead = _from("seq", "depth")
        heads = inside.groupBy("box").agg(
            F.count("*").alias("m"),
            F.first("parent").alias("up"),
            F.first("depth").alias("from"),
            F.first(F.slice("sizes", F.col("depth"), F.lit(_AHEAD + 1))).alias("path"),
            F.min(ahead).alias("low"),
            F.max(ahead).alias("high"),
        )
        # Turns that a whole container shares after its own: those that its first and last sequence share.
        same = F.expr(f"size(filter(sequence(1, {_AHEAD}), i -> length(low) >= {_ID} * i AND substring(low, 1, {_ID} * i) = substring(high, 1, {_ID} * i)))")
        heads = heads.filter(F.col("m") > limit).select("box", "up", "from", same.alias("jump"), "path")
        heads = stored(heads, "trie-heads")
        if heads.isEmpty():
            kept.append(inside)
            return reduce(DataFrame.unionByName, kept), rounds
        dealt = stored(join_hot(inside, heads.select("box", "jump"), ["box"], "seq"), f"trie-round-{len(rounds)}")
        kept.append(dealt.filter("jump IS NULL").drop("jump"))
        burst = dealt.filter("jump IS NOT NULL").withColumn("to", F.col("depth") + F.col("jump"))
        rounds.append((heads, burst.filter(f"length(seq) = {_ID} * to").select("box", "n", "conv_id", "ends_sha256")))
        inside = burst.filter(f"length(seq) > {_ID} * to").withColumns({"parent": F.col("box"), "box": _box("to + 1")})
        inside = inside.withColumns({"depth": F.col("to") + 1, "level": F.col("level") + 1}).drop("to", "jump")


def _summed(tops: DataFrame, ended: DataFrame, key: str) -> DataFrame:
    """What heads get from the tops of the containers and heads below them, and from sequences that end at them."""
    below = tops.select(F.col("parent").alias("box"), F.col("n_convs").alias("n"), "conv_id", F.lit(1).alias("one"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
    here = ended.select("box", "n", "conv_id", F.lit(0).alias("one"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), "ends_sha256")
    every = below.unionByName(here)
    return (every.groupBy(key) if key else every.groupBy()).agg(
        F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("one").cast("bigint").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).cast("bigint").alias("n_leaves"),
        F.sum("saved_tokens").cast("bigint").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(_EMPTY)).alias("ends_sha256"),
    )


def _chain(heads: DataFrame, sums: DataFrame, level: int) -> DataFrame:
    """The nodes of burst containers: what all of a container share, down to where it branches."""
    both = heads.join(sums, "box")
    each = both.select("*", F.explode(F.sequence(F.lit(0), F.col("jump"))).alias("i"))
    rest = F.aggregate(F.slice("path", F.col("i") + 1, F.col("jump") - F.col("i") + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    branch = F.col("i") == F.col("jump")
    return each.select(
        "box",
        F.col("up").alias("parent"),
        F.lit(level).alias("level"),
        (F.col("i") == 0).alias("top"),
        (F.col("from") + F.col("i")).cast("bigint").alias("depth"),
        "conv_id",
        F.when(F.col("i") > 0, F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(branch, F.col("n_children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        F.when(branch, F.col("ends_sha256")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(seqs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each distinct beginning of the sequences of :func:`sequences`, from the empty root on.

    ``conv_id`` is its smallest member, ``depth`` its number of turns, ``parent_conv_id`` its parent's ``conv_id`` (NULL at
    the root), ``n_convs`` its members, ``n_children`` its children; over its subtree, itself included, ``n_leaves``
    counts childless nodes and ``saved_tokens`` adds up (members - 1) times the bytes of the last text; ``ends_sha256`` is
    the digest of the ids of members that have no more turns, ascending, in decimal, joined by commas.

    Conversations without turns belong to the root alone. Without any conversation there is no node. Equal ids of 128
    bits count as equal turns. ``limit`` bounds the distinct sequences of a container; it has no influence on the result.
    """
    members = stored(seqs.withColumn("key", F.unhex(F.md5("seq"))), "trie-sequences")
    merged = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("seq").alias("seq"), F.first("sizes").alias("sizes")
    )
    distinct = stored(merged.join(ends_of(members), "key").drop("key"), "trie-distinct")
    inside, rounds = _burst(distinct, limit)
    order = ["box", "parent", "level", "depth", "seq", "sizes", "n", "conv_id", "ends_sha256"]
    dealt = inside.repartition("box").sortWithinPartitions("box", "seq").select(order)
    swept = stored(map_batches(dealt, _swept, _NODE), "trie-containers")
    nodes = [swept.filter("NOT top")]
    above = swept.filter("top").filter(F.col("level") == len(rounds) + 1)
    for level in range(len(rounds), 0, -1):
        heads, ended = rounds[level - 1]
        chain = stored(_chain(heads, _summed(above, ended, "box"), level), f"trie-level-{level}")
        convs = chain.filter("top").select("box", F.col("conv_id").alias("up_conv"))
        named = join_hot(above.drop("parent_conv_id"), convs.withColumnRenamed("box", "parent"), ["parent"], "box")
        nodes += [named.withColumnRenamed("up_conv", "parent_conv_id"), chain.filter("NOT top")]
        above = chain.filter("top").unionByName(swept.filter("top").filter(F.col("level") == level))
    ended = distinct.filter(F.length("seq") == 0).select(F.lit(None).cast("binary").alias("box"), "n", "conv_id", "ends_sha256")
    root = _summed(above, ended, "").filter("n_convs > 0")
    smallest = members.agg(F.min("conv_id")).first()[0]
    nodes.append(above.withColumn("parent_conv_id", F.lit(smallest).cast("bigint")))
    nodes.append(root.withColumns({"depth": F.lit(0).cast("bigint"), "parent_conv_id": F.lit(None).cast("bigint")}))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return reduce(DataFrame.unionByName, [n.select(names) for n in nodes])
