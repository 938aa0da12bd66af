"""Benchmark passages in documents, with a few edits: pigeonhole pieces, verified by bit-parallel edit distance.

An item of ``m`` characters may differ from a passage by ``m // CHARS_PER_EDIT`` edits. Split into one piece more than
that, at least one piece stands in the passage unchanged. One automaton over the pieces of all items finds those; the
surroundings of each hit are then compared with the whole item by Myers' algorithm, which keeps a column of the
edit-distance table in the bits of two integers.

Letters count in lower case and any white space counts as a space; nothing else is normalised. Items are searched in
slices of bounded size, each in one pass over the documents, so a benchmark of any size can be used.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabscope.llm.common import map_batches, per_process, small_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHARS_PER_EDIT = 20
#: Characters of benchmark text searched in one pass over the documents.
SLICE_CHARS = 4_000_000

_SPACES = {ord(c): " " for c in map(chr, range(0x3001)) if c.isspace()}


def normalized(text: str) -> str:
    """Lower case, white space as spaces; as long as ``text``, so places are the same."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_SPACES) if not low.isascii() else low.translate(_ASCII)


_ASCII = {i: " " for i in (*range(9, 14), *range(28, 32))}


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces that make up ``item``, with their places."""
    cuts = [i * len(item) // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any part of ``text``, and where the first such part ends (Myers)."""
    size = len(pattern)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best = (size, 0)
    for at, c in enumerate(text, 1):
        same = places.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best[0]:
            best = (score, at)
    return best


class Searcher:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[str], chars_per_edit: int) -> None:
        self.items = items
        self.edits = [len(t) // chars_per_edit for t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, text in enumerate(items):
            for at, piece in pieces(text, self.edits[i]):
                if piece:
                    found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item, distance, start, end)`` of the best passage of every item that ``text`` holds."""
        if not text or self.empty:
            return []
        text = normalized(text)
        begins: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for item, at in where:
                begins.setdefault(item, set()).add(end + 1 - size - at)
        out = []
        for item, starts in begins.items():
            best = self._verified(item, sorted(starts), text)
            if best:
                out.append((item, *best))
        return sorted(out)

    def _verified(self, item: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        pattern, edits = self.items[item], self.edits[item]
        best: tuple[int, int, int] | None = None
        i = 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * edits + 1:
                j += 1
            low, high = max(0, starts[i] - edits), min(len(text), starts[j] + len(pattern) + edits)
            distance, end = best_match(pattern, text[low:high])
            if distance <= edits and (best is None or distance < best[0]):
                # the same backwards gives the beginning
                _, back = best_match(pattern[::-1], text[low : low + end][::-1])
                best = (distance, low + end - back, low + end)
            i = j + 1
        return best


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items, as lists of bounded size."""
    items = benchmark.select("item_id", "text").filter("text is not null and text <> ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // SLICE_CHARS)
    for i in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i).collect()
        yield sorted(((r["item_id"], normalized(r["text"])) for r in part), key=repr)


def _searcher(items: list[tuple[object, str]], chars_per_edit: int) -> Searcher:
    name = zlib.crc32("\0".join(t for _, t in items).encode("utf-8", "replace"))
    return per_process(f"benchmark-{name}-{chars_per_edit}-{len(items)}", lambda: Searcher([t for _, t in items], chars_per_edit), large=True)


def find_passages(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``(doc_id, item_id, distance, edits, start, end)``: the best passage of each item that a document holds.

    ``docs`` has ``(doc_id, text)``, ``benchmark`` ``(item_id, text)``. Documents without a passage give no row; NULL
    and empty texts hold nothing; repeated documents and items are reported each. ``start`` and ``end`` are
    characters of the text, ``edits`` is how many were allowed. An empty table on either side gives an empty one.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_kind = rows.schema["doc_id"].dataType
    item_kind = benchmark.schema["item_id"].dataType
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, distance int, edits int, start int, end int"
    kinds = [to_arrow_type(doc_kind), to_arrow_type(item_kind), *[pa.int32()] * 4]

    def search(items: list[tuple[object, str]]) -> DataFrame:
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = _searcher(items, chars_per_edit)
            for batch in batches:
                found = []
                for row, text in enumerate(batch.column(1)):
                    for item, distance, start, end in made.find(text.as_py()):
                        found.append((batch.column(0)[row].as_py(), items[item][0], distance, made.edits[item], start, end))
                if found:
                    columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "edits", "start", "end"])

        return map_batches(rows, work, schema, large=True)

    out = None
    for items in _slices(benchmark):
        out = search(items) if out is None else out.unionByName(search(items))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The rows of ``docs`` that hold no passage of any item, all columns as they were."""
    schema = docs.schema

    def without(left: DataFrame, items: list[tuple[object, str]]) -> DataFrame:
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = _searcher(items, chars_per_edit)
            for batch in batches:
                for part in small_parts(batch, batch.schema.get_field_index("text")):
                    texts = part.column(part.schema.get_field_index("text"))
                    yield part.filter(pa.array([not made.find(t.as_py()) for t in texts], pa.bool_()))

        return map_batches(left, work, schema, large=True)

    for items in _slices(benchmark):
        docs = without(docs, items)
    return docs
