"""CSV records that may hold line breaks, from files that many tasks read.

A line alone does not say whether it begins inside a quoted cell. It does say what becomes of either case, so every line is
a function of one bit, and so is every block of a file. The functions of all blocks, applied one after the other over a
small table, tell each block how it begins; then every task puts its own lines together, and only records that cross the
border of two blocks are joined up afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.sources.shared import fresh_path

# Code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = '"'
# A line as a function: its low bit says whether text after it is quoted if the line begins outside quotes, the next bit
# the same if it begins inside.
_KEEP = 2
_BATCH = 10_000


def _function(line: Column, sep: str) -> Column:
    """What a line does to the quotes, from the texts before each of its quotes."""
    parts = F.split(line, QUOTE)
    texts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    outside, inside, closed, begin = (F.lit(i) for i in range(4))

    def step(state: Column, text: Column) -> Column:
        # A quote opens a cell at its very beginning, closes it, or is one of two that stand for a quote.
        again = F.when((state == closed) | (state == begin), inside).otherwise(outside)
        opened = F.when(text == "", again).when(F.endswith(text, F.lit(sep)), inside).otherwise(outside)
        return F.when(state == inside, closed).otherwise(opened)

    def after(state: Column) -> Column:
        return (F.aggregate(texts, state, step) == inside).cast("int")

    return F.when(F.instr(line, QUOTE) == 0, F.lit(_KEEP)).otherwise(after(begin) + 2 * after(inside)).cast("tinyint")


def _lines(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    lines = read.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        value.alias("line"),
    )
    return lines.withColumn("does", _function(F.col("line"), sep))


def quoted_after(does: np.ndarray, begins: int) -> np.ndarray:
    """Whether text is quoted after each line, given whether it is before the first one."""
    fixed = (does == 0) | (does == 3)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(does)), -1))
    turns = np.cumsum(does == 1)
    known = last >= 0
    value = np.where(known, does[last] == 3, begins != 0)
    since = turns - np.where(known, turns[last], 0)
    return (value.astype(np.int64) + since) % 2


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    size = len(keys[0])
    change = np.zeros(max(size - 1, 0), bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    bounds = [0, *(np.flatnonzero(change) + 1).tolist(), size]
    yield from zip(bounds[:-1], bounds[1:], strict=True)


_FACTS = "file bigint, block bigint, after0 int, after1 int, any0 int, any1 int, starts int"


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a task: for both ways to begin, how it ends and whether text in it is quoted."""
    blocks: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        file, block, does = (batch.column(i).to_numpy() for i in range(3))
        for a, b in _runs(file, block) if len(file) else ():
            key = int(file[a]), int(block[a])
            now = blocks.setdefault(key, [0, 1, 0, 0, 0])
            both = [quoted_after(does[a:b], now[i]) for i in (0, 1)]
            # A record starts on a line that does not begin inside quotes.
            now[4] |= int(now[1] == 0 or (both[1][:-1] == 0).any())
            now[2] |= int(both[0].any())
            now[3] |= int(both[1].any())
            now[0], now[1] = int(both[0][-1]), int(both[1][-1])
    if blocks:
        rows = [(*key, *facts) for key, facts in blocks.items()]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[p.split(" ")[0] for p in _FACTS.split(", ")])


def _blocks(lines: DataFrame) -> DataFrame:
    """``(file, block, begins, owner, broken)``: whether a block begins inside quotes, in which block the record that it
    then goes on with started, and whether any of its text is quoted across lines. One row for each block of a file."""
    facts = lines.select("file", "block", "does").mapInArrow(_facts, _FACTS)
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.col("after0") == F.col("after1")
    counted = facts.withColumn("turns", F.sum(F.when(~fixed & (F.col("after0") == 1), 1).otherwise(0)).over(upto))
    last = [F.last(F.when(fixed, F.col(c)), True).over(earlier) for c in ("after0", "turns")]
    turns = F.coalesce(F.last("turns").over(earlier), F.lit(0))
    begins = (F.coalesce(last[0], F.lit(0)) + turns - F.coalesce(last[1], F.lit(0))) % 2
    known = counted.withColumn("begins", begins.cast("int"))
    has_start = F.when((F.col("begins") == 0) | (F.col("starts") == 1), F.col("block"))
    broken = F.when(F.col("begins") == 1, 1).otherwise(F.col("any0"))
    return known.select("file", "block", "begins", F.last(has_start, True).over(earlier).alias("owner"), broken.alias("broken"))


_RECORD = "file bigint, block bigint, place bigint, piece bigint, whole boolean, record string"


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of a task's blocks, and the pieces of those that cross a border. ``place`` is a record's first line."""
    out: list[tuple] = []
    held: list[str] = []
    now = None  # the block whose lines are held
    start = place = number = quoted = 0

    def close(whole: bool) -> None:
        file, block, begins, owner = now
        foreign = begins and start < 0  # goes on with a record of an earlier block
        text = "\n".join(held)
        if whole and not foreign:
            text = text.removesuffix("\r")
        out.append((file, owner if foreign else block, -1 if foreign else start, block, whole and not foreign, text))
        held.clear()

    def batch_out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, names=[p.split(" ")[0] for p in _RECORD.split(", ")])

    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
        does, begins, owners = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_pylist()
        texts = batch.column(2).to_pylist()
        for a, b in _runs(*keys) if len(does) else ():
            here = int(keys[0][a]), int(keys[1][a]), int(begins[a]), owners[a]
            if now is None or here[:2] != now[:2]:
                if held:
                    close(False)
                now, number, quoted = here, 0, here[2]
                start = -1 if quoted else 0
            after = quoted_after(does[a:b], quoted).tolist()
            for text, ends_quoted in zip(texts[a:b], after, strict=True):
                if not held and not quoted:
                    start = number
                held.append(text)
                if not ends_quoted:
                    close(True)
                    start = number + 1
                number, quoted = number + 1, ends_quoted
            if len(out) >= _BATCH:
                yield batch_out()
    if held:
        close(False)
    if out:
        yield batch_out()


def csv_records(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame | None:
    """``(path, block, place, record)``: the records of CSV files without their headers, or None if none holds a line break.

    Files are read by as many tasks as they have blocks. The table of blocks that goes to every task has one row for each
    (some 100 MB of a file). Lines end at ``\\n``, before which ``\\r`` is dropped; empty lines outside quotes are no records.
    """
    lines = _lines(spark, path, sep, encoding)
    stored = fresh_path(spark, "csv-blocks")
    _blocks(lines).write.parquet(stored)
    blocks = spark.read.parquet(stored)
    if blocks.filter("broken = 1").isEmpty():
        return None
    told = lines.join(F.broadcast(blocks.drop("broken")), ["file", "block"]).select("file", "block", "line", "does", "begins", "owner")
    made = told.mapInArrow(_records, _RECORD)
    pieces = made.filter("NOT whole")
    # Few rows: at most two for each block, and as many as blocks for one record.
    first = F.max(F.when(F.col("piece") == F.col("block"), F.col("place")))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("piece", "record"))), lambda p: p["record"])
    joined = pieces.groupBy("file", "block").agg(first.alias("place"), F.array_join(texts, "\n").alias("record"))
    every = made.filter("whole").select("file", "block", "place", "record").unionByName(
        joined.select("file", "block", "place", F.regexp_replace("record", r"\r$", "").alias("record"))
    )
    filled = every.filter(F.trim(F.col("record")) != "")
    names = lines.select("file", "path").distinct()
    # The first record of a file is its header.
    heads = filled.filter("block = 0").groupBy("file").agg(F.min("place").alias("head"))
    marked = filled.join(F.broadcast(heads), "file", "left")
    rows = marked.filter("block > 0 OR place > head OR head IS NULL")
    return rows.join(F.broadcast(names), "file").select("path", "block", "place", "record")
