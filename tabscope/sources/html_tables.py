"""Tables out of a table of web pages."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The parser travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIELDS = "table_index int, row_index int, cells array<string>"
_KINDS = (pa.int32(), pa.int32(), pa.list_(pa.string()))
_NAMES = ("page_id", "table_index", "row_index", "cells")
_ROWS_PER_BATCH = 5_000
_TABLE_TAG = re.compile(r"</?table[^>]*>?", re.IGNORECASE | re.ASCII)


class _TableReader(HTMLParser):
    """Collects the cell texts of every table row, nested tables included.

    A row belongs to every table it stands in, and a cell to every row, the way a search for all
    descendants finds them. Closing tags that a browser would add are added here as well.
    """

    _SILENT = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list[str]]]] = []  # table > row > cell > pieces of text
        self._open: list[tuple[str, object]] = []
        self._silent = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        if tag in self._SILENT:
            self._silent += 1
        elif tag == "table":
            self.tables.append([])
            self._open.append((tag, self.tables[-1]))
        elif tag == "tr" and self._inside("table"):
            self._close_until("table", ("tr", "td", "th"))
            row: list[list[str]] = []
            for name, table in self._open:
                if name == "table":
                    table.append(row)
            self._open.append((tag, row))
        elif tag in ("td", "th") and self._inside("table"):
            self._close_until("table", ("td", "th"))
            if not self._open or self._open[-1][0] == "table":
                self.handle_starttag("tr", ())  # a cell outside any row opens one
            cell: list[str] = []
            for name, row in self._open:
                if name == "tr":
                    row.append(cell)
            self._open.append(("td", cell))

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag in ("td", "th") and self._inside("td", within="table"):
            self._close_until("table", ("td",))
        elif tag == "tr" and self._inside("tr", within="table"):
            self._close_until("table", ("tr", "td"))
        elif tag == "table" and self._inside("table"):
            while self._open.pop()[0] != "table":
                pass

    def handle_data(self, data: str) -> None:
        if not self._silent:
            for name, cell in self._open:
                if name == "td":
                    cell.append(data)

    def tables_open(self) -> bool:
        return any(name == "table" for name, _ in self._open)

    def _inside(self, tag: str, within: str | None = None) -> bool:
        for name, _ in reversed(self._open):
            if name == tag:
                return True
            if name == within:
                return False
        return False

    def _close_until(self, stop: str, tags: tuple[str, ...]) -> None:
        while self._open and self._open[-1][0] != stop and self._open[-1][0] in (*tags, "td"):
            if self._open[-1][0] == "tr" and "tr" not in tags:
                break
            self._open.pop()


def table_rows(html: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """``(table, row, cells)`` of one page; empty rows and empty tables are left out."""
    if not html:
        return
    reader = _TableReader()
    # Behind the last table tag no table begins; once all are closed there, the rest adds nothing.
    cut = max((tag.end() for tag in _TABLE_TAG.finditer(html)), default=0)
    reader.feed(html[:cut])
    if reader.tables_open() or reader.rawdata:  # rawdata: a tag or comment that is not complete yet
        reader.feed(html[cut:])
    reader.close()
    kept = 0
    for table in reader.tables:
        rows = [["".join(cell).strip() for cell in row] for row in table if row]
        yield from ((kept, i, cells) for i, cells in enumerate(rows))
        kept += bool(rows)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[object, int, int, list[str]]] = []
    key = pa.null()
    for batch in batches:
        key = batch.column(0).type
        for page_id, html in zip(batch.column(0), batch.column(1), strict=True):
            for table, row, cells in table_rows(html.as_py()):
                rows.append((page_id.as_py(), table, row, cells))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield _batch(rows, key)
                    rows = []
    if rows:
        yield _batch(rows, key)


def _batch(rows: list[tuple[object, int, int, list[str]]], key: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), (key, *_KINDS), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(_NAMES))


def extract_html_tables(pages: DataFrame) -> DataFrame:
    """``(page_id, table_index, row_index, cells)`` from a table with ``page_id``, of any type, and ``html``.

    Pages without a table are dropped by a text test first and never leave the JVM.
    """
    wanted = pages.filter(F.contains(F.lower("html"), F.lit("<table")))
    kind = pages.schema["page_id"].dataType.simpleString()
    return wanted.select("page_id", "html").mapInArrow(_extract, f"page_id {kind}, {_FIELDS}")


def table_cells(rows: DataFrame) -> DataFrame:
    """``(page_id, table_index, row_index, column_index, value)``: one row per cell."""
    return rows.select(
        "page_id", "table_index", "row_index", F.posexplode("cells").alias("column_index", "value")
    )


def widen_table_cells(rows: DataFrame, width: int | None = None) -> DataFrame:
    """Ragged rows as a rectangular table ``c0, c1, ...``; short rows are padded with NULL.

    The width decides the schema. If it is not given, it is looked up right away, which reads ``rows`` once more: store
    rows that are dear to make.
    """
    if width is None:
        width = rows.agg(F.max(F.size("cells")).alias("width")).first()["width"] or 0
    return rows.select(
        "page_id",
        "table_index",
        "row_index",
        *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(width)],
    )
