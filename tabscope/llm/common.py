"""What the text operators share: reading batches as arrays, hashing, stored intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.sources.shared import shared_folder

# Code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that array code looks at in one go; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: The same where many arrays of eight bytes for each byte of text are alive at once.
SMALL_SLICE = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_MIX = np.uint64(0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored_dir(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tabscope-llm-{spark.sparkContext.applicationId}"


def stored_path(spark: SparkSession, name: str) -> str:
    """An unused path in the folder of this application."""
    return f"{_stored_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(spark: SparkSession) -> None:
    """Removes all that :func:`stored` has written in this application; results not yet read are lost with it."""
    remove_path(spark, _stored_dir(spark))


#: Spark's setting for queries that remove their shuffle files when they are done.
_NO_LEFTOVERS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: computed once, with short lineage.

    ``options`` are those of Spark's Parquet writer. Shuffle files go when the table is written. The table stays until :func:`drop_tables`, :func:`drop_stored` or whoever
    clears the shared folder removes it.
    """
    spark = df.sparkSession
    path = stored_path(spark, name)
    before = spark.conf.get(_NO_LEFTOVERS, None)
    spark.conf.set(_NO_LEFTOVERS, "true")
    try:
        df.write.options(**{"compression": "snappy", **options}).parquet(path)
    finally:
        spark.conf.unset(_NO_LEFTOVERS) if before is None else spark.conf.set(_NO_LEFTOVERS, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Removes tables that :func:`stored` has returned, once all that is made from them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if f"/{_stored_dir(spark).rsplit('/', 1)[1]}/" in path:
                remove_path(spark, path)


#: Places among which :func:`join_hot` deals the rows of one key.
_PLACES = 64


def join_hot(rows: DataFrame, small: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``rows`` left-joined to ``small``, which has each of ``keys`` once; rows of one key go to many tasks by ``spread``.

    ``small`` is written out once for each place that rows may be dealt to, so it should be far smaller than ``rows``.
    """
    dealt = rows.withColumn("__place", F.pmod(F.xxhash64(spread), F.lit(_PLACES)).cast("int"))
    every = small.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(_PLACES - 1))))
    return dealt.join(every, [*keys, "__place"], "left").drop("__place")


#: Bits of the filter that :func:`likely_rows` sends to every task (4 MB).
_FILTER_BITS = 25


def _filter_hash(key: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key, F.lit("filter")), F.lit(1 << _FILTER_BITS))
    return (at / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))


def likely_rows(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted`` (one column), for a join that follows.

    The filter has one size whatever ``wanted`` holds; the more keys there are, the more other rows pass.
    """
    word, bit = _filter_hash(F.col(wanted.columns[0]))
    filled = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    words = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    words[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    word, bit = _filter_hash(F.col(key))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 2
            keep = words[batch.column(at).to_numpy()] & batch.column(at + 1).to_numpy() != 0
            yield batch.select(range(at)).filter(pa.array(keep))

    return map_batches(rows.select("*", word.alias("__word"), bit.alias("__bit")), work, rows.schema)


def per_process(key: str, make: Callable[[], object], *, large: bool = False) -> object:
    """``make()``, called once in a Python worker and kept for its later tasks.

    Of ``large`` things a worker keeps the last one alone: workers outlive the operator that they worked for.
    """
    kept = sys.__dict__.setdefault("_tabscope_llm_kept", {})
    if large:
        key = f"large {key}"
    if key not in kept:
        if large:
            _forget_large()
        kept[key] = make()
    return kept[key]


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _is_text(kind: pa.DataType) -> bool:
    return kind in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()) or pa.types.is_list(kind)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a column of texts or lists of numbers; NULL counts as empty."""
    if pa.types.is_list(column.type):
        values = column.flatten().to_numpy()  # without those of NULL rows
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return values.view(np.uint8), np.append(0, np.cumsum(sizes)) * values.itemsize
    if column.null_count:
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        column = pc.fill_null(column, b"" if binary else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, rows)
        start = end


def _forget_large() -> None:
    kept = sys.__dict__.get("_tabscope_llm_kept", {})
    for key in [k for k in kept if k.startswith("large ")]:
        del kept[key]


def _give_back() -> None:
    """Returns memory that is free inside the process to the system: idle workers stay for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    rows: DataFrame,
    work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: object,
    *,
    large: bool = False,
) -> DataFrame:
    """``rows.mapInArrow``, leaving Python workers small: without ``large``, large things that are kept go first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not large:
            _forget_large()
        try:
            yield from work(batches)
        finally:
            _give_back()

    return rows.mapInArrow(run, schema)


def small_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in row ranges of bounded size, by a text or list column."""
    data = batch.column(column)
    offsets = data.offsets.to_numpy().astype(np.int64) * 8 if pa.types.is_list(data.type) else text_buffers(data)[1]
    for start, end in slices(offsets):
        yield batch.slice(start, end - start)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with every bit depending on all others (a bijection)."""
    out = values ^ (values >> np.uint64(32))
    out *= _MIX
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, count - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


def powers(count: int, inverse: bool = False) -> np.ndarray:
    """``BASE^0 .. BASE^(count-1)`` modulo 2^64, or the same of its inverse."""
    size = max(1 << 16, 1 << max(0, count - 1).bit_length())
    base = pow(int(BASE), -1, 1 << 64) if inverse else int(BASE)
    if size > 1 << 21:  # one very long text: not kept
        return _powers(base, count)
    return per_process(f"powers-{inverse}-{size}", lambda: _powers(base, size))[:count]


def byte_codes() -> np.ndarray:
    """A random 64-bit number for each byte."""
    return per_process("byte-codes", lambda: np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; :func:`span_hashes` takes any span's hash from them."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_codes()[raw] * powers(len(raw)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal for equal bytes, wherever they stand."""
    back = powers(len(prefix), inverse=True)
    sizes = (ends - starts).astype(np.uint64)
    return mixed((prefix[ends] - prefix[starts]) * back[starts] + sizes * _MIX)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space, A-Z lowered) and where each row's words begin."""
    space = _SPACE[raw]
    starts_word = ~space
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    inner = starts_word.copy()
    inner[1:] &= space[:-1]
    inner[firsts] |= starts_word[firsts]
    starts = np.flatnonzero(inner)
    stop = np.append(space, True)
    marks = stop.copy()
    marks[offsets[1:]] = True
    bounds = np.flatnonzero(marks)
    ends = bounds[np.searchsorted(bounds, starts, "right")] if len(starts) else starts
    hashes = span_hashes(prefix_hashes(_LOWER[raw]), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def batches_out(
    batches: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """``work`` over row ranges of at most ``limit`` bytes of text, or of one row; the first column of texts or lists decides."""
    for batch in batches:
        if not batch.num_rows:
            continue
        first = next(c for c in batch.columns if _is_text(c.type))
        _, offsets = text_buffers(first)
        for start, end in slices(offsets, limit):
            yield from work(batch.slice(start, end - start))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
