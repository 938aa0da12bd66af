"""Removing passages that occur more than once in a corpus, byte by byte (see :mod:`tabscope.llm.suffix`)."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import batch_of, batches_out, map_batches, small_parts, stored, text_buffers, word_hashes
from tabscope.llm.suffix import data_hash, repeated_ranges, spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM = 400, 160
#: Words of a passage that different documents share, where words count too, and of the pieces that it is found by.
WORDS, WORD_GRAM = 50, 20
#: Bytes of a word's hash; strings of ``WORDS`` of them are compared.
_TOKEN = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _word_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (id, alt, seed, data) with a hash of each word instead of ``data``; A-Z and a-z are alike."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, bounds = word_hashes(*text_buffers(batch.column(3)))
        raw = (hashes >> np.uint64(64 - 8 * _TOKEN)).astype(np.uint32)
        buffers = [None, pa.py_buffer((bounds * _TOKEN).astype(np.int32)), pa.py_buffer(raw)]
        data = pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers)
        yield batch_of(id=batch.column(0), alt=batch.column(1), seed=batch.column(2), data=data)

    schema = "id bigint, alt bigint, seed bigint, data binary"
    return map_batches(rows.select("id", "alt", "seed", "data"), lambda batches: batches_out(batches, work), schema)


def _with_ranges(docs: DataFrame, length: int, gram: int, words: int = 0) -> DataFrame:
    """``docs`` with their repeated ranges; the columns are ``row`` (all of ``docs``), ``ranges`` in bytes and ``words``:
    ranges of that many words or more that different rows share."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # 128 bits name a row: two hashes of its text, one of them with its id. Rows equal in both are copies.
    name = F.xxhash64(F.lit("row"), F.col("doc_id").cast("bigint"), "data").alias("id")
    named = docs.select(whole, data.alias("data"), F.col("doc_id")).select("row", name, "data")
    rows = named.select("id", data_hash("data").alias("alt"), F.lit(0).cast("bigint").alias("seed"), "data")
    found = repeated_ranges(rows, length, gram)
    nothing = F.lit(None).cast(found.schema["ranges"].dataType)
    found = found.withColumn("words", nothing)
    if words:
        shared = repeated_ranges(_word_rows(rows), words, WORD_GRAM * words // WORDS, _TOKEN, distinct=True)
        found = found.unionByName(shared.select("id", "alt", nothing.alias("ranges"), F.col("ranges").alias("words")))
        found = stored(found.groupBy("id", "alt").agg(*[F.first(c, True).alias(c) for c in ("ranges", "words")]), "found")
    # A stored table, so that Spark can split copies that are many rows of one name.
    return named.select("row", "id", data_hash("data").alias("alt")).join(found, ["id", "alt"], "left").select("row", "ranges", "words")


def _in_bytes(raw: bytes, ranges: list[dict] | None) -> list[dict]:
    """Ranges of words as ranges of bytes."""
    if not ranges:
        return []
    words = [m.span() for m in _WORD.finditer(raw)]
    return [{"first": words[a][0], "symbols": words[b - 1][1] - words[a][0]} for a, b in spans(ranges, len(words))]


def _kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    view, at, out = memoryview(raw), 0, []
    for start, end in removed:
        out.append(view[at:start])
        at = end
    out.append(view[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, removed, kept)`` for every row of ``docs`` (``doc_id``, ``text``).

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same or another
    row; strings never cross rows. ``removed`` lists maximal (start, end) spans, ``kept`` holds the other bytes.
    NULL texts count as empty; repeated rows and rows that share an id are rows of their own; texts shorter than
    ``length`` stay whole; an empty table gives an empty one.
    """
    text = F.col("row.text").cast("string").cast("binary").alias("text")
    both = _with_ranges(docs.select("doc_id", "text"), length, gram).select(F.col("row.doc_id").alias("doc_id"), text, "ranges")
    kind = both.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in (part for whole in batches for part in small_parts(whole, 1)):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            cut = [spans(r, len(t)) for r, t in zip(batch.column(2).to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(b - a for a, b in c) for c in cut], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in c] for c in cut], pa.list_(span)),
                    pa.array([_kept(t, c) for t, c in zip(texts, cut, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "removed", "kept"],
            )

    spans_type = "array<struct<start: bigint, end: bigint>>"
    return map_batches(both, work, f"doc_id {kind}, n_bytes bigint, n_removed bigint, removed {spans_type}, kept binary")


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = 0) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the repeated bytes; ``n_chars``, if there, counts what is left.

    With ``words``, passages of that many words or more that stand in different rows go too, however few bytes they have.
    A character that loses some of its bytes goes whole. NULL texts stay NULL, repeated rows are cut alike, an empty
    table gives an empty one.
    """
    names = docs.columns
    found = "__ranges"
    while any(n.lower().startswith(found) for n in names):
        found += "_"
    both = _with_ranges(docs, length, gram, words)
    both = both.select("row.*", F.col("ranges").alias(found), F.col("words").alias(f"{found}words"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in (part for whole in batches for part in small_parts(whole, at)):
            texts: list[str | None] = []
            shorter: list[bool] = []
            for text, ranges, counted in zip(*(batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True):
                shorter.append(bool(ranges or counted))
                if text and shorter[-1]:
                    raw = text.encode()
                    text = _kept(raw, spans([*(ranges or ()), *_in_bytes(raw, counted)], len(raw))).decode("utf-8", "ignore")
                texts.append(text)
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                kind, before = columns["n_chars"].type, columns["n_chars"].to_pylist()
                sizes = [len(t) if c and t is not None else n for n, c, t in zip(before, shorter, texts, strict=True)]
                columns["n_chars"] = pa.array(sizes, kind)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return map_batches(both, work, docs.schema)
