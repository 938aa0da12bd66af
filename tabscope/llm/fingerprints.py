"""I-Match fingerprints.

The lexicon holds the words whose document frequency lies in a band: neither so frequent that they say nothing nor so
rare that a single edit brings them in. A document's words of the lexicon, distinct and sorted, are hashed once for
each of several random subsets of the lexicon. Documents with the same words in a subset have the same hash there.
Subsets come in four sizes, so that documents of any length have some that hold only a few of their words: there a
half rewritten document still agrees with what it was.

The likeness of two fingerprints is the share of equal hashes among the subsets that are not empty for both. A
document without any word of the lexicon is named by a hash of all its text.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.common import batch_of, map_batches, mixed, per_process, slices, stored, text_buffers
from tabscope.llm.terms import distinct_in_rows, row_words, term_counts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of the lexicon occur in at least / at most this share of the documents (and in two at least).
LOW, HIGH = 0.0005, 0.05
#: Share of the lexicon that each subset holds; four neighbours in this list are drawn by one hash.
SHARES = [1 / 8] * 16 + [1 / 32] * 32 + [1 / 128] * 48 + [1 / 512] * 32
_BATCH = 1 << 20


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the words inside the band, counted over all documents.

    Each of its words fills ``low`` of the documents, so there are at most (mean number of distinct words of a document) /
    ``low`` of them, of 8 bytes, whatever the number of documents. An empty table has an empty lexicon.
    """
    frequency = stored(term_counts(docs).filter("n > 1"), "terms")
    total = docs.count()
    inside = frequency.filter((F.col("n") >= low * total) & (F.col("n") <= max(2.0, high * total)))
    return np.sort(inside.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def fingerprints(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """A row of 16-bit hashes for each text, 0 for subsets that hold none of its words."""
    hashes, row, _ = row_words(texts)
    terms, row = distinct_in_rows(hashes, row)
    if len(words):
        at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
        known = words[at] == terms
        terms, row = terms[known], row[known]
    else:
        terms, row = terms[:0], row[:0]
    out = np.zeros((len(texts), len(SHARES)), np.uint16)
    for j, share in enumerate(SHARES):
        if j % 4 == 0:
            drawn = mixed(terms ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        inside = drawn.view(np.uint16)[j % 4 :: 4] < int(share * 65536)
        kept, of = drawn[inside], row[inside]
        if len(kept):
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            place = (np.arange(len(kept)) - np.repeat(begin, np.diff(np.append(begin, len(kept))))).astype(np.uint64)
            # the words are sorted: each is hashed with its place
            total = mixed(np.add.reduceat(mixed(kept + place), begin))
            out[of[begin], j] = (total % np.uint64(65535)).astype(np.uint16) + 1
    for i in np.flatnonzero(~out.any(axis=1)):
        name = xxhash.xxh64_intdigest((texts[int(i)].as_py() or "").encode("utf-8", "replace"))
        out[i, 0], out[i, 1:] = 0, np.array([(name * (2 * j + 1) >> 40) % 65535 + 1 for j in range(1, len(SHARES))])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among the subsets not empty for both, row by row."""
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(1, ((a > 0) | (b > 0)).sum(axis=1))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def fingerprint_documents(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``(doc_id, fingerprint)`` for every row; NULL counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _hex(fingerprints(batch.column(1), words))
            yield batch_of(doc_id=batch.column(0), fingerprint=pa.array(marks))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, f"doc_id {kind}, fingerprint string", large=True)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _buckets(spark: SparkSession, rows: DataFrame, parts: int) -> tuple[list[int], dict[int, list[tuple[int, int]]]]:
    """Upper ends of ranges of keys with about as many rows each; and which rows go to which other range as well.

    The first row of a range (largest key) follows the last one of the next higher range that has rows; that of the
    highest range follows the very last row. Two numbers for each of ``parts`` ranges come to the driver.
    """
    shares = [i / parts for i in range(1, parts)]
    ends = rows.select(F.percentile_approx("key", shares, 10 * parts).alias("ends")).first()["ends"] if shares else []
    ends = sorted({int(e) for e in ends or []})

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(np.array(ends, np.int64), batch.column(0).to_numpy(), "left")
            yield batch_of(bucket=pa.array(at.astype(np.int32)), key=batch.column(0), alt=batch.column(1))

    dealt = map_batches(rows.select("key", "alt"), work, "bucket int, key bigint, alt bigint")
    first = F.min(F.struct(F.bitwise_not("key").alias("down"), F.col("alt")))  # largest key, smallest hash of the text
    firsts = dealt.groupBy("bucket").agg(F.max("key").alias("key"), first["alt"].alias("alt"))
    filled = sorted((r["bucket"], r["key"], r["alt"]) for r in firsts.collect())
    return ends, {b: [(key, alt)] for (_, key, alt), (b, _, _) in zip(filled, filled[1:] + filled[:1], strict=True)}


def compare_edited(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text replaces the last half of a text by the beginning of the next document's, in descending order of
    ``doc_id``; after the last comes the first. NULL texts count as empty, NULL ids come last, rows that share an id are
    ordered by a hash of their text. The texts are shuffled once, compressed, into ranges of ids.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        key.alias("key"),
        F.xxhash64("text").alias("alt"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends, heads = _buckets(spark, rows, parts)
    also: dict[tuple[int, int], list[int]] = {}
    for bucket, found in heads.items():
        for place in found:
            also.setdefault(place, []).append(bucket)
    head_keys = {k for k, _ in also}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            _, offsets = text_buffers(batch.column(3))
            for start, end in slices(offsets):
                out: list[tuple] = []
                for doc_id, key, alt, text in zip(*(c.to_pylist() for c in batch.slice(start, end - start).columns), strict=True):
                    packed = packer.compress(text.encode("utf-8"))
                    out.append((bisect.bisect_left(ends, key), False, doc_id, key, alt, packed))
                    if key in head_keys:
                        out.extend((b, True, doc_id, key, alt, packed) for b in also.get((key, alt), ()))
                yield dealt(out)

    def dealt(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["bucket", "head", "doc_id", "key", "alt", "packed"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_process(f"lexicon-{len(words)}-{xxhash.xxh64_hexdigest(words.tobytes())}", lambda: words, large=True)
        unpack = zstandard.ZstdDecompressor()
        waiting: tuple[int, int | None, str] | None = None
        ready: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for bucket, head, doc_id, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                bucket, text = bucket.as_py(), unpack.decompress(packed.as_py()).decode("utf-8")
                if waiting and waiting[0] == bucket:
                    ready.append((waiting[1], waiting[2], text))
                    size += len(waiting[2])
                waiting = None if head.as_py() else (bucket, doc_id.as_py(), text)
                if size > _BATCH:
                    yield compared(ready, known)
                    ready, size = [], 0
        if ready:
            yield compared(ready, known)

    def compared(ready: list[tuple[int | None, str, str]], known: np.ndarray) -> pa.RecordBatch:
        changed = [edited(text, following) for _, text, following in ready]
        # a text that follows is mostly the next text as well
        names: dict[str, int] = {}
        for _, text, following in ready:
            names.setdefault(text, len(names))
            names.setdefault(following, len(names))
        marks = fingerprints(pa.array(list(names), pa.large_string()), known)
        own, after = marks[[names[t] for _, t, _ in ready]], marks[[names[f] for _, _, f in ready]]
        new = fingerprints(pa.array(changed, pa.large_string()), known)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _, _ in ready], pa.int64()),
                pa.array([len(t) for _, t, _ in ready], pa.int64()),
                pa.array(changed, pa.string()),
                pa.array(_hex(own)),
                pa.array(_hex(new)),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, after)),
            ],
            names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    spread = map_batches(rows, deal, "bucket int, head boolean, doc_id bigint, key bigint, alt bigint, packed binary")
    ordered = spread.repartition("bucket").sortWithinPartitions("bucket", F.col("head").asc(), F.col("key").desc(), "alt")
    marks = "fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = ordered.select("bucket", "head", "doc_id", "packed")
    made = map_batches(ordered, pairs, f"doc_id bigint, n_chars bigint, edited string, {marks}", large=True)
    digest = F.sha2("edited", 256).alias("edited_sha256")
    return made.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")
