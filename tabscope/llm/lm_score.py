"""Stupid-backoff scores of documents under a bigram model of the corpus around them.

Words are told apart by 64-bit hashes, bigrams by 80 bits of a hash of both words. Every word counts as itself; only words above a
share of :data:`FREQUENT`, at most ``1 / FREQUENT``, are sent to every task. On request (``rare`` above 0) words that make up
less than this share of all words, and words that occur once, count as one unknown word, so that the vocabulary has at most
``1 / rare`` words, whatever the corpus.

Documents are read into slices of about :data:`SLICE_WORDS` words, stored as numbers of words. Each slice asks for the counts of
its different bigrams and words: their hashes, sorted, in one packet for each part of the range of hashes. A part adds
up what all packets hold and answers each with counts in the same order, so neither hashes nor ids of documents travel back. What
a document itself has contributed to a bigram is taken off, so one that no other document has backs off to the word alone:

``S(w | v) = c(v w) / c(v)`` if ``c(v w) > 0``, else ``BACKOFF * c(w) / N``

with ``c(v w)`` over the other documents and the counts of single words, ``c(v)``, ``c(w)`` and their sum ``N``, over all.
A document starts behind a begin mark. The score of a document is the sum of the logarithms.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import BASE, batches_out, drop_tables, map_batches, mixed, stored, text_buffers
from tabscope.llm.terms import row_words, term_counts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Every word counts as itself.
RARE = 0.0
BACKOFF = 0.4
#: Without a cut: share of all words from which a word's count is sent to every task.
FREQUENT = 1e-5
#: Words that are no hashes: the begin mark and the unknown word.
BEGIN, UNKNOWN = 0, 1
#: Words of a slice, unless one document or a megabyte of text has more.
SLICE_WORDS = 1 << 20
#: Words of the corpus for each part of the range of hashes.
PART_WORDS = 1 << 20


def word_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """``(term, n)``, stored, for every word, and the number of all words."""
    counts = stored(term_counts(docs, distinct=False), "words")
    return counts, counts.agg(F.sum("n")).first()[0] or 0


def counted_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words in ``counts``, and their counts."""
    known = counts.toPandas()
    words = known["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], known["n"].to_numpy(np.int64)[order]


def vocabulary(counts: DataFrame, total: int, rare: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that are not rare, and their counts. At most ``1 / rare`` words."""
    return counted_words(counts.filter((F.col("n") >= rare * total) & (F.col("n") > 1)))


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in planes, compressed."""
    (data,) = in_planes(values, np.array([len(values)]))
    return pa.compress(data.as_buffer(), codec="zstd", asbytes=True) + bytes([len(data.as_buffer()) // max(1, len(values))])


def unpacked(data: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers that :func:`packed` was given."""
    raw = pa.decompress(data[:-1], data[-1] * size, codec="zstd", asbytes=True)
    return from_planes(pa.array([raw], pa.binary()), np.array([size]))


def in_planes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ``sizes`` unsigned numbers, of each run the lowest bytes, then the next ones, as many for all as the largest needs."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    ends = np.cumsum(sizes)
    at = np.arange(len(values)) + np.repeat((ends - sizes) * (width - 1), sizes)
    out, step = np.empty(len(values) * width, np.uint8), np.repeat(sizes, sizes)
    for plane in range(width):
        out[at + plane * step] = (values >> np.uint64(8 * plane)).astype(np.uint8)
    offsets = np.append(0, ends * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def from_planes(runs: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs that :func:`in_planes` has made, maybe in several calls."""
    raw, offsets = text_buffers(runs)
    ends, widths = np.cumsum(sizes), np.diff(offsets) // np.maximum(sizes, 1)
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - (ends - sizes), sizes)
    out, step = np.zeros(len(at), np.uint64), np.repeat(sizes, sizes)
    for plane in range(widths.max()):
        has = slice(None) if plane < widths.min() else np.repeat(widths > plane, sizes)
        out[has] |= raw[at[has] + plane * step[has]].astype(np.uint64) << np.uint64(8 * plane)
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences modulo 2^64; sums of them give ``values`` again."""
    return np.diff(values, prepend=np.uint64(0))


def part_starts(parts: int) -> np.ndarray:
    """The smallest hash of each of ``parts`` even parts."""
    return (((np.arange(parts, dtype=np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts)) << np.uint64(32)


def _in_words(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted ``words`` each hash would be, and whether it is there."""
    if not len(words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


def word_slices(docs: DataFrame, words: np.ndarray | None) -> DataFrame:
    """``(slice, ids, sizes, n_terms, terms, n_words, places)``: rows with words, their words as numbers of different ones.

    Of ``sizes`` each row of the slice has one, its number of words. Words outside of ``words``, if given, are the unknown one.
    """

    def hashed(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        hashes, _, bounds = row_words(batch.column(1))
        if words is not None:
            hashes = np.where(_in_words(words, hashes)[1], hashes, np.uint64(UNKNOWN))
        sizes = np.diff(bounds)
        if len(hashes):
            yield batch.column(0).filter(pa.array(sizes > 0)), sizes[sizes > 0], hashes

    def row(number: int, held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, hashes = (list(x) for x in zip(*held, strict=True))
        ids, hashes = pa.concat_arrays(ids), np.concatenate(hashes)
        terms, places, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        # Common words get low numbers, which take little room; among words of one count, sorted hashes do.
        order = np.lexsort((terms, -counts))
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        fields = {
            "slice": pa.array([number], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "sizes": pa.array([packed(np.concatenate(sizes))], pa.binary()),
            "n_terms": pa.array([len(terms)], pa.int64()),
            "terms": pa.array([packed(steps(terms[order]))], pa.binary()),
            "n_words": pa.array([len(hashes)], pa.int64()),
            "places": pa.array([packed(ranks[places])], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for part in batches_out(batches, hashed):
            held.append(part)
            size += len(part[2])
            if size >= SLICE_WORDS:
                yield row(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield row(number, held)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "slice bigint, ids array<bigint>, sizes binary, n_terms bigint, terms binary, n_words bigint, places binary"
    return map_batches(rows, work, kind)


class Slice:
    """The words of one row of :func:`word_slices`, and the order in which it asks for counts."""

    def __init__(self, row: dict, near: np.ndarray) -> None:
        self.number, self.ids = row["slice"], row["ids"]
        self.sizes = unpacked(row["sizes"], len(self.ids)).astype(np.int64)
        self.terms = np.cumsum(unpacked(row["terms"], row["n_terms"]))
        second = unpacked(row["places"], row["n_words"]).astype(np.int64)
        # The begin mark is the first word of all, so others come one later.
        first = np.zeros(len(second), np.int64)
        first[1:] = second[:-1] + 1
        first[np.cumsum(self.sizes) - self.sizes] = 0
        self.grams = first * len(self.terms) + second
        self.pairs, self.counts = np.unique(self.grams, return_counts=True)
        self.first, self.second = np.divmod(self.pairs, len(self.terms))
        self.near_at, self.is_near = _in_words(near, self.terms)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of bigrams and of words that are not near: order, 64 bits in this order, more bits, own counts.

        Words have no more bits, bigrams have some. Own counts of words are 0, as a table of them is asked.
        """
        v, w = np.append(np.uint64(BEGIN), self.terms)[self.first], self.terms[self.second]
        far = self.terms[~self.is_near]
        keys = np.concatenate([mixed(mixed(v * BASE) + w), far])
        marks = np.concatenate([np.maximum(mixed(mixed(w * BASE) + v) >> np.uint64(48), np.uint64(1)), np.zeros(len(far), np.uint64)])
        counts = np.concatenate([self.counts, np.zeros(len(far), np.int64)])
        order = np.argsort(keys, kind="stable")
        return order, keys[order], marks[order], counts[order]

    def scores(self, answers: np.ndarray, near: np.ndarray, begun: int, total: int, backoff: float) -> np.ndarray:
        """Score of each row. ``answers`` has what was asked for, without own counts; ``near`` the counts of near words."""
        order = self.asked()[0]
        found = np.empty(len(order), np.int64)
        found[order] = answers
        pairs = found[: len(self.pairs)] + self.counts
        single = np.empty(len(self.terms))
        single[self.is_near] = near[self.near_at[self.is_near]]
        single[~self.is_near] = found[len(self.pairs) :]
        first, miss = np.log(np.append(begun, single)), np.log(backoff * single / total)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        own, n = np.unique(row * len(self.pairs) + np.searchsorted(self.pairs, self.grams), return_counts=True)
        row, pair = np.divmod(own, len(self.pairs))
        others = pairs[pair] - n
        hit = np.log(np.maximum(others, 1)) - first[self.first[pair]]
        return np.bincount(row, n * np.where(others > 0, hit, miss[self.second[pair]]), len(self.sizes))


_PACKET = "part int, slice bigint, n int, keys binary, marks binary, counts binary"


def _packets(number: int | None, keys: np.ndarray, marks: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Sorted ``keys``, as steps from the start of their part, with what belongs to them: a row for each part that has some."""
    begins = part_starts(parts)
    part = np.searchsorted(begins, keys, "right") - 1
    first = np.flatnonzero(np.diff(part, prepend=-1))
    sizes = np.diff(np.append(first, len(part)))
    gaps = steps(keys)
    gaps[first] = keys[first] - begins[part[first]]
    fields = {
        "part": pa.array(part[first].astype(np.int32)),
        "slice": pa.array([number] * len(first), pa.int64()),
        "n": pa.array(sizes.astype(np.int32)),
        "keys": in_planes(gaps, sizes),
        "marks": in_planes(marks, sizes),
        "counts": in_planes(counts, sizes),
    }
    return pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))


def _row_dicts(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def gram_questions(texts: DataFrame, near: np.ndarray, parts: int) -> DataFrame:
    """Packets with the bigrams of each slice, how often it has them, and its words that are not ``near``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _row_dicts(batches):
            yield _packets(row["slice"], *Slice(row, near).asked()[1:], parts)

    return map_batches(texts, work, _PACKET)


def word_packets(counts: DataFrame, parts: int) -> DataFrame:
    """Packets with all of ``counts``, which nobody wants an answer to."""

    def packets(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        terms, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("term", "n"))
        order = np.argsort(terms.view(np.uint64))
        return _packets(None, terms.view(np.uint64)[order], np.zeros(len(terms), np.uint64), n[order], parts)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SLICE_WORDS:
                yield packets(held)
                held, size = [], 0
        if size:
            yield packets(held)

    return map_batches(counts, work, _PACKET)


def gram_answers(asked: DataFrame, parts: int) -> DataFrame:
    """``(slice, part, n, others)``: for each packet of a slice, what the other packets hold of each of its keys."""

    def add_up(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = table["n"].to_numpy().astype(np.int64)
        gaps, marks, counts = (from_planes(table[c].combine_chunks(), sizes) for c in ("keys", "marks", "counts"))
        first = np.cumsum(sizes) - sizes
        # Sums run on over all packets: each begins anew at the start of the part.
        keys = np.cumsum(gaps)
        keys -= np.repeat(keys[first] - gaps[first] - part_starts(parts)[table["part"].to_numpy()], sizes)
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        if (same & (np.diff(marks[order]) != 0)).any():
            order = np.lexsort((marks, keys))
            same = np.diff(keys[order]) == 0
        starts = np.flatnonzero(np.append(True, ~same | (np.diff(marks[order]) != 0)))
        others = np.empty(len(keys), np.uint64)
        others[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.append(starts, len(keys))))
        others -= counts
        wanted = table["slice"].is_valid().to_numpy()
        fields = {c: table[c].filter(pa.array(wanted)) for c in ("slice", "part", "n")}
        return pa.table(fields | {"others": in_planes(others[np.repeat(wanted, sizes)], sizes[wanted])})

    return asked.groupBy("part").applyInArrow(add_up, "slice bigint, part int, n int, others binary")


def slice_scores(
    texts: DataFrame, answers: DataFrame, near: tuple[np.ndarray, np.ndarray], begun: int, total: int, backoff: float
) -> DataFrame:
    """``(doc_id, n_words, score)`` for every row that has words."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = _row_dicts(left.to_batches())
        found = right.sort_by("part").combine_chunks()
        others = from_planes(found["others"].combine_chunks(), found["n"].to_numpy().astype(np.int64))
        one = Slice(row, near[0])
        scores = one.scores(others, near[1], begun, total, backoff)
        return pa.table({"doc_id": pa.array(one.ids, pa.int64()), "n_words": pa.array(one.sizes), "score": pa.array(scores)})

    both = texts.groupBy("slice").cogroup(answers.groupBy("slice"))
    return both.applyInArrow(score, "doc_id bigint, n_words bigint, score double")


def score_documents(docs: DataFrame, rare: float = RARE, backoff: float = BACKOFF) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log)`` for every row of ``docs`` (``doc_id``, ``text``).

    Only with ``rare`` above 0 are rare words taken for one another. Empty and NULL texts have no words, a score of 0 and a NULL mean. Rows
    that share an id each get the sums over all of them, and are other documents to each other. An empty table gives an
    empty one; ids are cast to bigint.
    """
    counts, total = word_table(docs)
    if rare > 0:
        words, known = vocabulary(counts, total, rare)
        near = np.append(np.uint64(UNKNOWN), words), np.append(total - known.sum(), known)
        far = counts.limit(0)
    else:
        words = None
        frequent = F.col("n") >= FREQUENT * total
        near = counted_words(counts.filter(frequent))
        far = counts.filter(~frequent)

    texts = stored(word_slices(docs, words), "word-slices")
    begun = texts.agg(F.sum(F.size("ids"))).first()[0] or 0
    parts = max(1, -(-total // PART_WORDS))
    asked = gram_questions(texts, near[0], parts).union(word_packets(far, parts))
    answers = stored(gram_answers(asked, parts), "gram-answers", compression="zstd")
    drop_tables(counts)
    scored = slice_scores(texts, answers, near, begun, total, backoff)
    sums = stored(
        scored.groupBy(F.col("doc_id").alias("key")).agg(F.sum("n_words").alias("n_words"), F.sum("score").alias("score")),
        "scores",
    )
    drop_tables(texts, answers)
    names = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return names.join(sums, names["doc_id"].eqNullSafe(sums["key"]), "left").select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce("score", F.lit(0.0)).alias("log_score"),
        (F.col("score") / F.col("n_words")).alias("mean_log"),
    )
