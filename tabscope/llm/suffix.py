"""Passages that occur more than once, by suffix arrays.

A string of ``length`` symbols that starts in more than one place is found in three steps.

1. *Anchors.* In every window of ``length`` symbols the smallest hash of its ``gram``-symbol pieces names the window's
   anchor. Equal windows have equal anchors at the same place, so only windows whose anchor occurs twice can repeat.
   Neighbouring windows share an anchor; together they form a segment.
2. *Suffix arrays.* Segments with the same anchor are put side by side. Their suffixes are ordered by two-stage sorting:
   only suffixes smaller than their successors are compared directly, all others are induced by scanning the
   buckets of first symbols. Neighbours in that order with a common prefix of ``length`` symbols repeat.
   Equal segments are counted and sorted once; an anchor that has a single segment content needs no order at all.
3. An anchor with more than :data:`GROUP` different segments (the edge of a very common passage) is not gathered: its
   windows are counted one by one, by a hash of their content, over all tasks.

Hashes of 64 bits only bring candidates together in step 1; in step 3, and for equal segments, equal hashes count as
equal content.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import (
    SMALL_SLICE,
    batch_of,
    batches_out,
    drop_tables,
    likely_rows,
    map_batches,
    mixed,
    prefix_hashes,
    span_hashes,
    stored,
    text_buffers,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different segments of one anchor that one task orders.
GROUP = 2048
#: Segments that are ordered together.
_TOGETHER = 1024
_SALT = np.uint64(0xA24BAED4963EE407)
#: Bits of an anchor that say whether it occurs twice: the first ones deal it out, the others take five bytes.
_DEALT, _REST = 12, 40
#: Anchors that a task holds before it deals them out.
_HELD = 1 << 20
#: Shares of the rows that are cut one after the other.
_SHARES = 3


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``wanted`` (a mask over ``text``), ordered by at least the first ``depth`` bytes that follow.

    Two-stage sorting: a suffix that is smaller than its successor is compared directly; the order of the others follows
    from a scan over the buckets of first bytes, as each is its first byte in front of a suffix placed before.
    """
    size = len(text)
    if not size or not wanted.any():
        return np.empty(0, np.int64)
    differs = np.append(text[1:] != text[:-1], True)  # the end is smaller than any byte
    at = np.where(differs, np.arange(size), size)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the run that a position stands in ends
    padded = np.append(text, 0).astype(np.int16)
    padded[-1] = -1
    smaller = padded[at] < padded[at + 1]
    # An induced suffix needs its successor, up to the next one that is compared directly.
    needed = wanted.copy()
    stops = np.where(smaller, np.arange(size), size)
    stops = np.minimum.accumulate(stops[::-1])[::-1]
    first = np.flatnonzero(wanted & ~smaller)
    change = np.zeros(size + 2, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(stops[first] + 1, size), -1)
    needed |= np.cumsum(change[:size]) > 0

    raw = text.tobytes()
    direct = np.flatnonzero(needed & smaller).tolist()
    direct.sort(key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)
    heads = text[direct]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[size - 1] and not smaller[size - 1]:
        waiting[text[size - 1]].append(np.array([size - 1]))
    out: list[np.ndarray] = []
    for byte in range(256):
        bucket = waiting[byte]
        wave = np.concatenate(bucket) if bucket else np.empty(0, np.int64)
        waves = []
        while len(wave):  # runs of this byte, shorter ones first
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[needed[before] & (text[before] == byte)]
        low, high = np.searchsorted(heads, [byte, byte + 1]) if byte < 255 else (np.searchsorted(heads, 255), len(heads))
        waves.append(direct[low:high])
        done = np.concatenate(waves)
        if not len(done):
            continue
        out.append(done)
        before = done[done > 0] - 1
        before = before[needed[before] & (text[before] > byte)]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out)
    return order[wanted[order]]


def repeated_windows(
    segments: list[bytes],
    windows: list[int],
    length: int,
    unit: int,
    weights: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    distinct: bool,
) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` windows (``length`` bytes, every ``unit`` bytes) repeat.

    ``weights`` counts the equal copies of a segment and ``low``/``high`` are the smallest and largest owner among
    them. With ``distinct`` a window has to occur with two owners, else in two places.
    """
    raw = b"".join(segments)
    text = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])])[:-1]
    counts = np.array(windows, np.int64)
    owner = np.repeat(np.arange(len(segments)), counts)
    places = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * unit
    wanted = np.zeros(len(text), bool)
    wanted[places] = True
    order = suffix_order(text, wanted, length)
    # adjacent common prefixes: do neighbours agree in all of ``length``?
    neighbours = zip(order[:-1].tolist(), order[1:].tolist(), strict=True)
    same = np.array([raw[a : a + length] == raw[b : b + length] for a, b in neighbours], bool)
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    group = owner[np.searchsorted(places, order)]
    if distinct:
        hit = np.minimum.reduceat(low[group], begins) < np.maximum.reduceat(high[group], begins)
    else:
        hit = np.add.reduceat(weights[group], begins) > 1
    marked = np.zeros(len(text), bool)
    marked[order[np.repeat(hit, np.diff(np.append(begins, len(order))))]] = True
    flat = marked[places]
    return np.split(flat, np.cumsum(counts)[:-1])


def _anchored(raw: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, length: int, gram: int, unit: int) -> tuple[np.ndarray, ...]:
    """Segments of all rows: ``(row, first window, windows, anchor, content)``; lengths in symbols of ``unit`` bytes."""
    symbols = len(raw) // unit
    bounds = offsets // unit
    prefix = prefix_hashes(raw)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][row]
    place = np.arange(symbols)
    whole = place + gram <= ends
    hashes = np.full(symbols, np.uint64(0xFFFFFFFFFFFFFFFF))
    at = place[whole]
    hashes[whole] = mixed(span_hashes(prefix, at * unit, (at + gram) * unit) + seeds[row[whole]])
    # minimum and leftmost place of it over as many pieces as a window has
    bits = max(1, int(symbols).bit_length())
    keyed = (hashes >> np.uint64(bits) << np.uint64(bits)) | place.astype(np.uint64)
    keyed[~whole] = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = length - gram + 1
    pad = -symbols % width
    table = np.append(keyed, np.full(pad + width, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).reshape(-1)
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = np.flatnonzero(place + length <= ends)
    least = np.minimum(backward[windows], forward[windows + width - 1])
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    firsts = np.flatnonzero(new)
    first, at = windows[firsts], anchor[firsts]
    count = np.diff(np.append(firsts, len(windows)))
    content = mixed(span_hashes(prefix, first * unit, (first + count - 1 + length) * unit) + (at - first).astype(np.uint64) * _SALT)
    return row[first], first - bounds[:-1][row[first]], count, hashes[at].view(np.int64), content.view(np.int64)


def data_hash(data: str) -> Column:
    """64 bits that tell rows of one id apart; rows equal in id and data have one name."""
    return F.xxhash64(F.col(data).cast("binary"))


def _twice(found: DataFrame) -> DataFrame:
    """``(key)``: the first 52 bits of every anchor that stands in two rows of ``found``.

    Anchors travel in packets of five bytes each, and those that a task has seen twice go twice, not more often.
    """
    cut = np.uint64(64 - _DEALT - _REST)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packets() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            third = np.zeros(len(keys), bool)
            third[2:] = keys[2:] == keys[:-2]
            keys = keys[~third]
            bounds = np.searchsorted(keys >> np.uint64(_REST), np.arange((1 << _DEALT) + 1, dtype=np.uint64))
            parts = np.flatnonzero(np.diff(bounds))
            raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _REST // 8].tobytes()
            size = _REST // 8
            data = [raw[bounds[p] * size : bounds[p + 1] * size] for p in parts.tolist()]
            return batch_of(part=pa.array(parts.astype(np.int32)), data=pa.array(data, pa.binary()))

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64) >> cut)
            if sum(map(len, held)) >= _HELD:
                yield packets()
                held = []
        if any(map(len, held)):
            yield packets()

    def several(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column(1).to_pylist()), np.uint8).reshape(-1, _REST // 8)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, : _REST // 8] = raw
        keys = np.sort(keys.view("<u8").reshape(-1))
        keys = np.unique(keys[1:][keys[1:] == keys[:-1]])
        high = np.uint64(table.column(0)[0].as_py()) << np.uint64(_REST)
        return pa.table({"key": pa.array((keys | high).view(np.int64))})

    return map_batches(found.select("anchor"), deal, "part int, data binary").groupBy("part").applyInArrow(several, "key bigint")


def _shared_segments(found: DataFrame) -> DataFrame:
    """Segments whose anchor several owners have, and whether it has several contents.

    Most segments stand on one page alone. They go before owners and contents of an anchor are looked at.
    """
    key = F.shiftrightunsigned("anchor", 64 - _DEALT - _REST)
    twice = stored(_twice(found), "twice")
    likely = stored(likely_rows(found.withColumn("key", key), "key", twice).join(twice, "key").drop("key"), "likely")
    owner = F.xxhash64("id", "alt")
    facts = likely.groupBy("anchor").agg(
        F.min("content").alias("c1"), F.max("content").alias("c2"), F.min(owner).alias("p1"), F.max(owner).alias("p2")
    )
    shared = stored(facts.filter("p1 <> p2").select("anchor", (F.col("c1") != F.col("c2")).alias("mixed")), "shared")
    segments = stored(likely.join(shared, "anchor"), "segments")
    drop_tables(twice, likely, shared)
    return segments


def repeated_ranges(rows: DataFrame, length: int, gram: int, unit: int = 1, distinct: bool = False) -> DataFrame:
    """``(id, alt, ranges)``: where windows of ``length`` symbols repeat, for rows that have such.

    ``rows`` has ``id`` (bigint, not NULL), ``seed`` (bigint: only rows of equal seed are compared) and ``data`` (binary or string,
    ``unit`` bytes a symbol, or an array of integers of four bytes). ``ranges`` lists (first symbol, number of symbols) and may overlap. ``alt`` is the
    :func:`data_hash`, unless ``rows`` has its own; rows equal in both names are copies and have one row of ranges, each of
    them listed once.
    """
    if "alt" not in rows.columns:
        rows = rows.withColumn("alt", data_hash("data"))
    size = length * unit

    def anchors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = text_buffers(batch.column(3))
        seeds = mixed(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        row, first, count, anchor, content = _anchored(raw, offsets, seeds, length, gram, unit)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(row)),
                batch.column(1).take(pa.array(row)),
                pa.array(first.astype(np.int32)),
                pa.array(count.astype(np.int32)),
                pa.array(anchor),
                pa.array(content),
            ],
            names=["id", "alt", "first", "windows", "anchor", "content"],
        )

    schema = "id bigint, alt bigint, first int, windows int, anchor bigint, content bigint"
    found = map_batches(rows.select("id", "alt", "seed", "data"), lambda batches: batches_out(batches, anchors, SMALL_SLICE), schema)
    # Owners as numbers that keep "the same or not": equal numbers for equal owners.
    owner = F.xxhash64("id", "alt")
    if distinct:
        segments = _shared_segments(found)
    else:
        facts = found.groupBy("anchor").agg(F.min("content").alias("c1"), F.max("content").alias("c2"), F.count(F.lit(1)).alias("n"))
        # Tables that a large side is joined with are stored first: then Spark can split an anchor with very many rows.
        shared = stored(facts.filter("n > 1").select("anchor", (F.col("c1") != F.col("c2")).alias("mixed")), "shared")
        segments = stored(found.join(shared, "anchor"), "segments")
        drop_tables(shared)

    # One row for each different segment of an anchor, its copies counted.
    kinds = (
        segments.filter("mixed")
        .groupBy("anchor", "content")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("id", "alt", "first", "windows")).alias("one"),
            F.min(owner).alias("low"),
            F.max(owner).alias("high"),
        )
    )
    kinds = stored(kinds, "kinds")
    many = stored(kinds.groupBy("anchor").count().filter(F.col("count") > GROUP).select("anchor", F.lit(True).alias("many")), "many")
    wanted = kinds.join(many, "anchor", "left").select(
        F.col("one.id").alias("id"),
        F.col("one.alt").alias("alt"),
        F.struct(
            "anchor",
            "content",
            F.col("one.first").alias("first"),
            F.col("one.windows").alias("windows"),
            "copies",
            "low",
            "high",
            F.coalesce("many", F.lit(False)).alias("hot"),
        ).alias("part"),
    )
    by_row = stored(wanted.groupBy("id", "alt").agg(F.collect_list("part").alias("parts")), "wanted")
    drop_tables(kinds, many)
    # Whole rows are dealt out to be cut: one share of them after the other, so that their copies take little disk.
    shares = [
        stored(_cut(likely_rows(rows.filter(share), "id", part.select("id")), part, length, unit), "share")
        for share, part in ((s, by_row.filter(s)) for s in (F.pmod("id", F.lit(_SHARES)) == k for k in range(_SHARES)))
    ]
    pieces = stored(reduce(DataFrame.unionByName, shares), "pieces")
    drop_tables(by_row, *shares)
    cold = pieces.filter("window is null").drop("window", "place")
    ordered = _ordered(cold, size, unit, distinct)

    # Very common anchors: count windows one by one.
    windows = pieces.filter("window is not null")
    counted = windows.groupBy("window").agg(
        F.sum("copies").alias("total"), F.min(F.least("low", "high")).alias("a"), F.max(F.greatest("low", "high")).alias("b")
    )
    common = stored(counted.filter("a <> b" if distinct else "total > 1").select("window"), "common")
    spread = windows.join(common, "window").select("anchor", "content", F.col("place").alias("start"), F.lit(1).alias("run"))

    marks = ordered.unionByName(spread)
    some = segments.filter("mixed").join(marks, ["anchor", "content"]).select(
        "id", "alt", (F.col("first") + F.col("start")).alias("first"), (F.col("run") + F.lit(length - 1)).alias("symbols")
    )
    every = segments.filter("not mixed").select("id", "alt", "first", (F.col("windows") + F.lit(length - 1)).alias("symbols"))
    ranges = some.unionByName(every).groupBy("id", "alt").agg(F.collect_set(F.struct("first", "symbols")).alias("ranges"))
    ranges = stored(ranges, "ranges")
    drop_tables(segments, pieces, common)
    return ranges


_PIECE = "anchor bigint, content bigint, windows int, copies bigint, low bigint, high bigint, bytes binary, window bigint, place int"


def _cut(rows: DataFrame, by_row: DataFrame, length: int, unit: int) -> DataFrame:
    """The bytes of the wanted segments; for hot anchors a hash of each window instead."""
    # Copies of a row are merged inside each task: pieces are cut from one of them.
    data = F.col("data").cast("binary") if rows.schema["data"].dataType.simpleString() == "string" else F.col("data")
    texts = rows.select("id", "alt", data.alias("data")).dropDuplicates(["id", "alt"])
    both = texts.join(by_row, ["id", "alt"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for data, parts in zip(batch.column(0), batch.column(1), strict=True):
                raw = data.values.to_numpy().tobytes() if isinstance(data, pa.ListScalar) else data.as_py()
                for p in parts.as_py():
                    begin = p["first"] * unit
                    end = begin + (p["windows"] - 1 + length) * unit
                    fixed = (p["anchor"], p["content"], p["windows"], p["copies"], p["low"], p["high"])
                    if p["hot"]:
                        piece = np.frombuffer(raw, np.uint8)[begin:end]
                        starts = np.arange(p["windows"]) * unit
                        names = span_hashes(prefix_hashes(piece), starts, starts + length * unit)
                        names += np.uint64(p["anchor"] & 0xFFFFFFFFFFFFFFFF)
                        out.extend((*fixed, None, w, i) for i, w in enumerate(names.view(np.int64).tolist()))
                        size += 100 * p["windows"]
                    else:
                        out.append((*fixed, raw[begin:end], None, None))
                        size += end - begin
                if size > 4 << 20:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return map_batches(both.select("data", "parts"), work, _PIECE)


def _ordered(pieces: DataFrame, size: int, unit: int, distinct: bool) -> DataFrame:
    """``(anchor, content, start, run)``: runs of repeated windows, segments ordered anchor by anchor."""

    def one(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(group)
        anchor, content, count, copies, low, high = (table.column(i).to_numpy() for i in range(6))
        low, high = np.minimum(low, high), np.maximum(low, high)
        flags = repeated_windows(table.column(6).to_pylist(), count.tolist(), size, unit, copies, low, high, distinct)
        out: list[tuple[int, int, int, int]] = []
        for i, hit in enumerate(flags):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            out.extend((anchor[i], content[i], a, b - a) for a, b in edges.reshape(-1, 2).tolist())
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "start", "run"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by anchor: whole anchors are taken together until there is enough to order.
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                if rows + batch.num_rows < _TOGETHER:
                    held.append(batch)
                    rows += batch.num_rows
                    break
                anchors = batch.column(0).to_numpy()
                cut = np.flatnonzero(np.diff(anchors)) + 1
                last = held[-1].column(0)[-1].as_py() if held else None
                if held and last != anchors[0]:
                    cut = np.append(0, cut)
                cut = cut[rows + cut >= _TOGETHER]
                if not len(cut):
                    held.append(batch)
                    rows += batch.num_rows
                    break
                at = int(cut[0])
                if at:
                    held.append(batch.slice(0, at))
                yield from one(held)
                held, rows = [], 0
                batch = batch.slice(at)
        if held:
            yield from one(held)

    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor")
    return map_batches(dealt, work, "anchor bigint, content bigint, start int, run int")


def spans(ranges: list[dict] | None, limit: int) -> list[tuple[int, int]]:
    """Overlapping or touching (first, symbols) ranges as maximal (start, end) spans below ``limit``."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((r["first"], r["first"] + r["symbols"]) for r in ranges or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, min(end, limit)))
    return [(a, min(b, limit)) for a, b in out]
