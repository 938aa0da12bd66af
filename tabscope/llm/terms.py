"""Counts of words over a corpus, as 64-bit hashes, added up in batches before they are shuffled."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import batches_out, map_batches, text_buffers, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def row_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, the row of each, and where each row's words begin."""
    hashes, bounds = word_hashes(*text_buffers(column))
    return hashes, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), bounds


def distinct_in_rows(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, rows in order, and the row of each."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new]


def term_counts(docs: DataFrame, text: str = "text", distinct: bool = True) -> DataFrame:
    """``(term, n)``: in how many rows (``distinct``), or how often, each word occurs. NULL texts have no words."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, row, _ = row_words(batch.column(0))
        if distinct:
            hashes, _ = distinct_in_rows(hashes, row)
        terms, counts = np.unique(hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], names=["term", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"))
    counted = map_batches(rows, lambda batches: batches_out(batches, work), "term bigint, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))
