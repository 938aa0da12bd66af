"""Near-duplicate documents: MinHash banding, exact confirmation, connected components.

Documents with the same shingle set are one node from the start, so large groups of copies cost one row each and no
pair. Bands of equal minima name candidates. In each bucket every member is paired with its centre; when the
links found that way have been joined into components, buckets that still hold several components compare their
members across components, so that no link between members is lost. Every link is confirmed on the full shingle
sets. Components come from alternating large-star and small-star steps on the
table of links.

With the default 32 bands of 4 minima, a pair at a similarity of 0.75 misses all bands with a probability of 6e-6,
and one of 0.85 with 1e-10.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import SMALL_SLICE, batch_of, batches_out, likely_rows, map_batches, mixed, per_process, stored, text_buffers, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
#: Links need 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 75
#: Signatures that agree in fewer places than this cannot belong to linked documents, but for a chance below 1e-5.
SIGNATURE_LEAST = 0.57
#: Members of a bucket that one task compares at a time; larger buckets are dealt out in pairs of blocks.
BLOCK = 512
_STEP = np.uint64(0x9DDFEA08EB382D69)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin."""
    hashes, bounds = word_hashes(raw, offsets)
    counts = np.diff(bounds)
    sums = np.zeros(len(hashes), np.uint64)
    for i in range(words):
        factor = np.uint64(pow(int(_STEP), i + 1, 1 << 64))
        sums[: max(0, len(hashes) - i)] += hashes[i:] * factor
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - bounds[:-1][row] if len(hashes) else np.empty(0, np.int64)
    whole = place + words <= counts[row]
    # A row with fewer words has its whole sequence as the one shingle.
    for r in np.flatnonzero((counts > 0) & (counts < words)):
        start, end = bounds[r], bounds[r + 1]
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for i, h in enumerate(hashes[start:end]):
                total += h * np.uint64(pow(int(_STEP), i + 1, 1 << 64))
            sums[start] = total + np.uint64(end - start)
        whole[start] = True
    values, owner = mixed(sums[whole]), row[whole]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    def make() -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(4)
        full = (1 << 64) - 1
        return rng.integers(0, full, BANDS * ROWS, np.uint64) | np.uint64(1), rng.integers(0, full, BANDS * ROWS, np.uint64)

    return per_process("minhash-factors", make)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each non-empty row, the minima of BANDS * ROWS universal hashes over its shingles (upper 32 bits)."""
    factors, shifts = _factors()
    filled = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(filled), len(factors)), np.uint32)
    if len(filled):
        starts = bounds[:-1][filled]
        work = np.empty_like(values)
        for i, (a, b) in enumerate(zip(factors, shifts, strict=True)):
            np.multiply(values, a, out=work)
            np.add(work, b, out=work)
            out[:, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


_SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary"


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, signature)``: the set's size, a 128-bit name of it, and its minima."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, bounds = shingle_sets(*text_buffers(batch.column(1)))
        sizes = np.diff(bounds)
        names = np.zeros((2, len(sizes)), np.uint64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            names[0, filled] = np.add.reduceat(values, bounds[:-1][filled])
            names[1, filled] = np.add.reduceat(mixed(values ^ _STEP), bounds[:-1][filled])
        minima = signatures(values, bounds)
        packed: list[bytes | None] = [None] * len(sizes)
        for r, row in zip(filled, minima, strict=True):
            packed[r] = row.tobytes()
        yield batch_of(
            doc_id=batch.column(0),
            n_shingles=pa.array(sizes.astype(np.int64)),
            set_a=pa.array(names[0].view(np.int64)),
            set_b=pa.array(names[1].view(np.int64)),
            signature=pa.array(packed, pa.binary()),
        )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, lambda batches: batches_out(batches, work, SMALL_SLICE), _SKETCH)


def _bands(nodes: DataFrame) -> DataFrame:
    """``(bucket, node)``: a row for each band of each node."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.array([pow(int(_STEP), i + 1, 1 << 64) for i in range(ROWS)], np.uint64)
        for batch in batches:
            raw, _ = text_buffers(batch.column(1))
            minima = raw.view(np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            bucket = mixed((minima * factors).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), pa.array(ids)], names=["bucket", "node"])

    return map_batches(nodes.select("node", "signature"), work, "bucket bigint, node bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those ``(a, b)`` whose full shingle sets are similar enough; ``texts`` has ``(node, text)``."""
    # Repeated ids: any of their texts may make the link, as in the sketches.
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one, at_one = shingle_sets(*text_buffers(batch.column(2)))
        two, at_two = shingle_sets(*text_buffers(batch.column(3)))
        keep = np.zeros(batch.num_rows, bool)
        for r in range(batch.num_rows):
            x, y = one[at_one[r] : at_one[r + 1]], two[at_two[r] : at_two[r + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[r] = common > 0 and 100 * common >= LINK_PERCENT * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return map_batches(both, lambda batches: batches_out(batches, work, SMALL_SLICE), "a bigint, b bigint").distinct()


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those ``(a, b)`` whose signatures agree in enough places."""
    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("y"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (text_buffers(batch.column(i))[0].view(np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            keep = (x == y).mean(axis=1) >= SIGNATURE_LEAST
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return map_batches(rows, work, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: for every node with a link, the smallest node reachable.

    Large-star links all larger neighbours of a node to its smallest neighbour, small-star does so with the smaller
    ones and itself; repeated in turn until the links stop changing, they form stars around the smallest nodes.
    """
    spark = links.sparkSession
    both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(both, "links")
    sign = None
    while True:
        # large-star: from both ends; every node's larger neighbours go to its smallest neighbour or itself
        ends = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ends.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small-star: every node's smaller neighbours, and itself, go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("x"), "m")
            .filter("x <> m")
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == tuple(now):
            break
        sign = tuple(now)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node")))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [packer.compress((t.as_py() or "").encode("utf-8")) for t in batch.column(1)]
        yield batch_of(node=batch.column(0), packed=pa.array(texts, pa.binary()))


def _across(labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between members of one bucket that belong to different components, on their full sets.

    In each bucket, the members outside its most frequent component are compared with all members of other components.
    Both sides are dealt out in blocks, so a bucket of any size is spread over many tasks. A task counts common shingles
    through an index of its block and gives back one link for each member and other component at most.
    """
    counts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = (
        counts.groupBy("bucket")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("top"), F.sum("n").alias("all"))
        .filter("top < all")
        .select(
            "bucket", "main", F.ceil((F.col("all") - F.col("top")) / BLOCK).alias("lefts"), F.ceil(F.col("all") / BLOCK).alias("rights")
        )
    )
    packed = stored(map_batches(texts, _packed, "node bigint, packed binary"), "packed")
    rows = labelled.join(main, "bucket").join(packed, "node")
    out = ["bucket", "l", "r", "side", "node", "component", "packed"]
    left = rows.filter("component <> main").select(
        "*",
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("lefts")).alias("l"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rights") - 1)).alias("r"),
        F.lit(0).alias("side"),
    )
    right = rows.select(
        "*",
        F.pmod(F.xxhash64("node", F.lit(2)), F.col("rights")).alias("r"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lefts") - 1)).alias("l"),
        F.lit(1).alias("side"),
    )

    def work(group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        values, bounds = shingle_sets(*text_buffers(pa.array([unpack.decompress(p) for p in group["packed"]], pa.large_binary())))
        node, component, side = (group[c].to_numpy() for c in ("node", "component", "side"))
        sizes = np.diff(bounds)
        shingle = np.unique(values, return_inverse=True)[1]
        owner = np.repeat(np.arange(len(group)), sizes)
        listed = np.flatnonzero(side[owner] == 1)
        listed = listed[np.argsort(shingle[listed], kind="stable")]
        begin = np.searchsorted(shingle[listed], np.arange(len(values) + 1))
        found: list[tuple[int, int]] = []
        for r in np.flatnonzero(side == 0):
            own = shingle[bounds[r] : bounds[r + 1]]
            many = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(owner[listed[at]], minlength=len(group))
            near = np.flatnonzero((100 * common >= LINK_PERCENT * (sizes + sizes[r] - common)) & (common > 0) & (component != component[r]))
            for o in near[np.unique(component[near], return_index=True)[1]]:
                found.append((max(node[r], node[o]), min(node[r], node[o])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = left.select(out).union(right.select(out))
    return dealt.groupBy("bucket", "l", "r").applyInPandas(work, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs`` (``doc_id``, ``text``).

    Rows that share a ``doc_id`` are one document: it is linked if any of them is, and they stay or go together.
    NULL and empty texts have no shingles and no links; a NULL id has no component and is kept. Ids are cast to bigint;
    an empty table gives an empty one.
    """
    sketch = stored(sketches(docs), "sketches")
    named = sketch.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets: one node, the smallest id. The signature goes with it.
    sets = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    copies = (
        named.join(sets.filter("copies > 1"), ["set_a", "set_b"])
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        .filter("a <> b")
    )
    nodes = stored(
        named.join(sets.select("set_a", "set_b", F.col("node").alias("first")), ["set_a", "set_b"])
        .filter("doc_id = first")
        .select(F.col("doc_id").alias("node"), "signature")
        .dropDuplicates(["node", "signature"]),
        "nodes",
    )
    banded = _bands(nodes)
    size = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("members"))
    members = stored(banded.join(size.filter("first < last"), "bucket").select("bucket", "node", "members"), "buckets")
    shared = members.select("node").distinct()
    # Texts are fetched for documents that share a bucket only.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text"))
    texts = stored(likely_rows(rows, "node", shared).join(shared, "node", "left_semi"), "texts")
    # What copies were made from shares more buckets with them than they do with each other: the centre of a bucket is
    # its member with the most company in all its buckets.
    company = members.groupBy("node").agg(F.sum("members").alias("company"))
    most = F.struct("company", F.bitwise_not("node"))  # the smallest id of several
    centres = members.join(company, "node").groupBy("bucket").agg(F.max_by("node", most).alias("centre"))
    pairs = (
        members.join(centres, "bucket")
        .filter("node <> centre")
        .select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
        .distinct()
    )
    pairs = stored(pairs, "pairs")
    linked = stored(_confirmed(_agreeing(pairs, nodes), texts), "confirmed").union(copies)
    found = components(linked)

    # Buckets that still hold several components: compare their members across components.
    labelled = stored(
        members.filter("members > 2")
        .select("bucket", "node")
        .distinct()
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node")),
        "labelled",
    )
    more = stored(_across(labelled, texts), "late")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    found = found.select(F.col("node").alias("doc_id"), F.col("component").alias("found"))
    return sketch.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("found", "doc_id").alias("component_id"),
        F.coalesce("found", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, all columns as they were."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")
