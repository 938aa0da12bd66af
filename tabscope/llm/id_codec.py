"""Token ids in a compact binary form: adaptive context mixing with a range coder, in independent blocks.

Three predictions say what the next id may be: the id that followed the last two ids before (order 2), the one that
followed the last id (order 1), and the ids seen so far (order 0, by a small table that names each with few bits). How
likely each is right is learnt as coding goes on, for order 2 by the confidence of both higher orders and whether they agree;
the three are mixed into one distribution over all ids, with what is left for ids that none predicts. A range coder
turns the interval of the id that comes into bytes.

Blocks start from nothing: each can be decoded alone and carries the CRC-32 of its ids. That makes them fit for array
code as well: the blocks of a frame are coded side by side, one lane each. A frame holds whole documents, their ids
and counts, and its blocks; frames are rows of a Parquet table, ordered by document id.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.bpe import byte_letters
from tabscope.llm.common import batch_of, list_array, map_batches, per_process, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"TIDS2"
#: Ids of one block at most, blocks that are coded side by side, and ids that fill a frame.
BLOCK, LANES = 2048, 1024
FRAME = BLOCK * LANES
#: Slots (as bits) of a lane's tables of predictions, and of ids seen.
_SLOTS, _SEEN = 11, 10
#: How fast what is learnt about predictions changes.
_RATE = np.float32(0.04)
_TOP, _BOTTOM = np.uint64(1 << 56), np.uint64(1 << 48)
_U8, _U56 = np.uint64(8), np.uint64(56)
#: Bits of a distribution's total at most.
_TOTAL = 44


class _Model:
    """The predictions of all lanes."""

    def __init__(self, lanes: int, bits: int) -> None:
        self.bits, self.share = bits, min(20, _TOTAL - bits)
        kind = np.int32 if bits <= 24 else np.int64
        none = 1 << bits
        lane = np.arange(lanes)
        self.slots, self.seen_base = lane << _SLOTS, lane << _SEEN
        # predicted id and confidence (0: none yet) of each slot
        self.first = np.full(lanes << _SLOTS, none << 2, kind)
        self.second = np.full(lanes << _SLOTS, none << 2, kind)
        self.seen = np.full(lanes << _SEEN, none, kind)
        level = np.array([0.004, 0.2, 0.5, 0.8], np.float32)
        self.right2 = np.tile(np.repeat(level, 8), lanes)
        self.right1 = np.tile(level, lanes)
        self.right0 = np.full(lanes, np.float32(0.5))
        self.stat2, self.stat1 = lane << 5, lane << 2
        self.last = np.zeros(lanes, np.int64)
        self.last2 = np.zeros(lanes, np.int64)
        self.full = np.int64(1 << self.share)

    def predict(self) -> None:
        """Mixes the predictions into shares of the total: order 2, order 1, order 0; the rest is for all other ids."""
        mask = (1 << _SLOTS) - 1
        one = self.last * 40503
        self.at1 = self.slots + (one >> 5 & mask)
        self.at2 = self.slots + ((one + self.last2 * 60493 >> 4) & mask)
        self.entry1, self.entry2 = self.first.take(self.at1), self.second.take(self.at2)
        self.guess1, self.guess2 = self.entry1 >> 2, self.entry2 >> 2
        self.sure1, self.sure2 = self.entry1 & 3, self.entry2 & 3
        self.agree = self.guess1 == self.guess2
        self.which2 = self.stat2 + (self.sure2 << 3 | self.sure1 << 1 | self.agree)
        self.which1 = self.stat1 + self.sure1
        self.p2, self.p1, self.p0 = self.right2.take(self.which2), self.right1.take(self.which1), self.right0
        left = np.float32((1 << self.share) - 8)
        self.share2 = (self.p2 * left).astype(np.int64) + 1
        rest = left - self.p2 * left
        first = self.p1 * rest
        first[self.agree] = 0
        self.share1 = first.astype(np.int64) + 1
        self.share0 = ((rest - first) * self.p0).astype(np.int64) + 1
        self.below1 = self.share2 + self.share1
        self.below0 = self.below1 + self.share0
        self.others = self.full - self.below0

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold ``value``."""
        high = value >> self.bits
        place = (value - (self.below1 << self.bits)) // (self.share0 << (self.bits - _SEEN))
        seen = self.seen.take(self.seen_base + (place & ((1 << _SEEN) - 1)))
        other = (value - (self.below0 << self.bits)) // self.others
        out = np.where(high < self.below0, seen, other)
        out = np.where(high < self.below1, self.guess1, out)
        return np.where(high < self.share2, self.guess2, out)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the intervals of ``ids``."""
        self.hit2 = ids == self.guess2
        self.same1 = ids == self.guess1
        slot = ids * 40503 >> 3 & ((1 << _SEEN) - 1)
        self.at0 = self.seen_base + slot
        self.hit0 = self.seen.take(self.at0) == ids
        seen_size = self.share0 << (self.bits - _SEEN)
        start = np.where(self.hit0, (self.below1 << self.bits) + seen_size * slot, (self.below0 << self.bits) + self.others * ids)
        size = np.where(self.hit0, seen_size, self.others)
        start = np.where(self.same1, self.share2 << self.bits, start)
        size = np.where(self.same1, self.share1 << self.bits, size)
        start[self.hit2] = 0
        size = np.where(self.hit2, self.share2 << self.bits, size)
        return start, size

    def learn(self, ids: np.ndarray) -> None:
        """Takes note of ``ids`` after :meth:`interval` has been asked about them."""
        self.right2[self.which2] = self.p2 + (self.hit2 - self.p2) * _RATE
        tried = (~(self.hit2 | self.agree)).nonzero()[0]
        p1 = self.p1.take(tried)
        self.right1[self.which1.take(tried)] = p1 + (self.same1.take(tried) - p1) * _RATE
        missed = (~(self.hit2 | self.same1)).nonzero()[0]
        p0 = self.p0.take(missed)
        self.right0[missed] = p0 + (self.hit0.take(missed) - p0) * _RATE
        np.minimum(self.right0, np.float32(0.98), out=self.right0)
        new = ids << 2 | 1
        kept = np.where(self.sure1 > 1, self.entry1 - 1, new)
        self.first[self.at1] = np.where(self.same1, self.entry1 + (self.sure1 < 3), kept)
        kept = np.where(self.sure2 > 1, self.entry2 - 1, new)
        self.second[self.at2] = np.where(self.hit2, self.entry2 + (self.sure2 < 3), kept)
        self.seen[self.at0] = ids
        self.last2, self.last = self.last, ids


def _settled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The lanes whose highest byte is settled; where the width gets too small it is cut so that it is."""
    settled = (low ^ (low + width)) < _TOP
    small = (~settled & (width < _BOTTOM)).nonzero()[0]
    if len(small):
        width[small] = -low[small] & (_BOTTOM - np.uint64(1))
        settled[small] = True
    return settled.nonzero()[0]


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """The bytes of each block of ids below ``2 ** bits``; at most LANES blocks, longer ones first."""
    sizes = np.array([len(b) for b in blocks])
    lanes, steps = len(blocks), int(sizes.max())
    ids = np.zeros((steps, lanes), np.int64)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    model = _Model(lanes, bits)
    total = np.uint64(model.share + bits)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    most = steps * (-(-_TOTAL // 8) + 2) + 16
    out = np.zeros(lanes * most, np.uint8)
    begin = np.arange(lanes) * most
    at = begin.copy()
    lengths = np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for step in range(steps):
            now = ids[step]
            model.predict()
            start, size = model.interval(now)
            unit = width >> total
            low += unit * start.view(np.uint64)
            width = unit * size.view(np.uint64)
            while len(done := _settled(low, width)):
                where, head = at.take(done), low.take(done)
                out[where] = head >> _U56
                at[done] = where + 1
                low[done] = head << _U8
                width[done] = width.take(done) << _U8
            model.learn(now)
            for i in (sizes == step + 1).nonzero()[0] if step + 1 in (steps, int(sizes[-1])) else ():
                out[at[i] : at[i] + 8] = np.frombuffer(int(low[i]).to_bytes(8, "big"), np.uint8)  # what is left of its number
                lengths[i] = at[i] + 8 - begin[i]
    return [out[b : b + n].tobytes() for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)]


def decode_blocks(coded: list[bytes], sizes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of each block."""
    lanes, steps = len(coded), int(sizes.max())
    most = max(map(len, coded)) + 16
    data = np.zeros((lanes, most), np.uint8)
    for i, c in enumerate(coded):
        data[i, : len(c)] = np.frombuffer(c, np.uint8)
    model = _Model(lanes, bits)
    total = np.uint64(model.share + bits)
    top = np.uint64((1 << (model.share + bits)) - 1)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    code = data[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
    data = data.reshape(-1)
    end = np.arange(1, lanes + 1) * most - 1
    at = np.arange(lanes) * most + 8
    ids = np.zeros((steps, lanes), np.uint32)
    with np.errstate(over="ignore"):
        for step in range(steps):
            model.predict()
            unit = width >> total
            value = np.minimum((code - low) // np.maximum(unit, np.uint64(1)), top).view(np.int64)
            now = model.find(value).astype(np.int64)
            start, size = model.interval(now)
            low += unit * start.view(np.uint64)
            width = unit * size.view(np.uint64)
            while len(done := _settled(low, width)):
                where = at.take(done)
                code[done] = code.take(done) << _U8 | data.take(np.minimum(where, end.take(done)))
                at[done] = where + 1
                low[done] = low.take(done) << _U8
                width[done] = width.take(done) << _U8
            model.learn(now)
            ids[step] = now
    return [ids[: sizes[i], i] for i in range(lanes)]


def pack(ids: np.ndarray, vocabulary: int) -> bytes:
    """A frame's blocks: bits of an id, number of blocks; for each its ids, bytes and CRC-32; then all their bytes."""
    bits = max(_SEEN, (int(vocabulary) - 1).bit_length())
    if not len(ids):
        return MAGIC + struct.pack("<BI", bits, 0)
    size = int(min(BLOCK, max(256, -(-len(ids) // LANES))))
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    coded: list[bytes] = []
    for i in range(0, len(blocks), LANES):
        coded += encode_blocks(blocks[i : i + LANES], bits)
    heads = b"".join(struct.pack("<III", len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())) for b, c in zip(blocks, coded, strict=True))
    return MAGIC + struct.pack("<BI", bits, len(blocks)) + heads + b"".join(coded)


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame; raises if a block's checksum is not right."""
    if frame[: len(MAGIC)] != MAGIC:
        raise ValueError("no frame of token ids")
    bits, count = struct.unpack_from("<BI", frame, len(MAGIC))
    heads = np.frombuffer(frame, "<u4", 3 * count, len(MAGIC) + 5).reshape(-1, 3)
    ends = np.cumsum(heads[:, 1].astype(np.int64)) + len(MAGIC) + 5 + 12 * count
    out: list[np.ndarray] = []
    for i in range(0, count, LANES):
        part = heads[i : i + LANES]
        coded = [frame[e - n : e] for e, n in zip(ends[i : i + LANES].tolist(), part[:, 1].tolist(), strict=True)]
        out += decode_blocks(coded, part[:, 0].astype(np.int64), bits)
    for ids, check in zip(out, heads[:, 2].tolist(), strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError("a block of token ids is damaged")
    return np.concatenate(out) if out else np.empty(0, np.uint32)


# Fixed value: how the word-end vocabulary splits text, in lower case, into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text of these code points needs no normalisation but lower case, and ``regex`` splits it as the library does.
_SIMPLE = regex.compile("[^\\x00-\\u012f\\u0131-\\u02ff\\u2010-\\u2027]")
_KEPT_WORDS, _KEPT_SIZE = 600_000, 48


class WordEncoder(dict):
    """Ids of what stands between white space, by the tokenizers library, kept for what has been seen before.

    No word of this vocabulary holds or sees white space, so a text's ids are those of its parts.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.find = regex.compile(_WORDS).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})

    def __missing__(self, part: bytes) -> bytes:
        words = (w.encode("utf-8").decode("latin-1").translate(self.letters) for w in self.find(part.decode("utf-8")))
        ids = np.array([t.id for w in words for t in self.model.tokenize(w)], "<u4").tobytes()
        if len(self) >= _KEPT_WORDS:
            self.clear()
        if len(part) <= _KEPT_SIZE:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if (not text.isascii() and _SIMPLE.search(text)) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # as bytes, text is split at ASCII white space only; any other is left to the pattern
        return b"".join(map(self.__getitem__, text.lower().encode("utf-8").split()))


def word_encoder(path: str) -> WordEncoder:
    return per_process(f"words-{path}", lambda: WordEncoder(path), large=True)


_FRAMES = "part int, frame int, doc_ids array<bigint>, sizes array<bigint>, data binary"


def write_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Frames of the token ids of ``docs`` (``doc_id``, ``text``) in ascending order of ``doc_id``, as a stored table.

    Each document's ids are followed by ``end_id``. NULL and empty texts have that id alone; NULL ids come first; rows
    that share an id are ordered by a hash of their text; ids are cast to bigint; an empty table gives no frames.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("alt"), F.col("text").cast("string").alias("text")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "alt")
    ordered = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = word_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        total, frame, part = 0, 0, None

        def packed() -> pa.RecordBatch:
            data = pack(np.frombuffer(b"".join(t for _, t in held), "<u4"), max(made.size, end_id + 1))
            columns = [[part], [frame], [[i for i, _ in held]], [[len(t) // 4 for _, t in held]], [data]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "frame", "doc_ids", "sizes", "data"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for number, doc_id, text in zip(*batch.columns, strict=True):
                part = number.as_py()
                text = text.as_py()
                held.append((doc_id.as_py(), (made.encode(text) if text else b"") + end))
                total += len(held[-1][1]) // 4
                if total >= FRAME:
                    yield packed()
                    held, total, frame = [], 0, frame + 1
        if held:
            yield packed()

    return stored(map_batches(ordered, work, _FRAMES, large=True), "token-ids")


def read_documents(frames: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, decoded from frames; ``start`` counts the ids before it."""
    sizes = frames.select("part", "frame", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    # One row for each task that has written frames.
    passed, starts = 0, []
    for part, n in sorted(map(tuple, sizes.groupBy("part").agg(F.sum("n")).collect())):
        starts.append((part, passed))
        passed += n
    parts = frames.sparkSession.createDataFrame(starts, "part int, passed bigint")
    earlier = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("passed") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    begins = sizes.join(F.broadcast(parts), "part").select("part", "frame", begin.alias("begin"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, doc_ids, counts, data in zip(*batch.columns, strict=True):
                ids = unpack(data.as_py())
                counts = np.array(counts.as_py(), np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)])
                starts = ends[:-1] + begin.as_py()
                doc_ids = doc_ids.as_py()
                for i in range(0, len(counts), 1000):
                    j = min(i + 1000, len(counts))
                    lists = list_array(ids[ends[i] : ends[j]].astype(np.int64), ends[i : j + 1] - ends[i], pa.int64())
                    yield batch_of(
                        doc_id=pa.array(doc_ids[i:j], pa.int64()), start=pa.array(starts[i:j]), n_tokens=pa.array(counts[i:j]), ids=lists
                    )

    rows = frames.join(begins, ["part", "frame"]).select("begin", "doc_ids", "sizes", "data")
    return map_batches(rows, work, "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>")


def with_checksums(documents: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            raw = lists.values.to_numpy().astype("<u4").tobytes()
            bounds = lists.offsets.to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            doc_id, start, n_tokens = batch.columns[:3]
            yield batch_of(doc_id=doc_id, start=start, n_tokens=n_tokens, ids_crc32=pa.array(sums, pa.int64()))

    return map_batches(documents, work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
