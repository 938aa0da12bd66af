"""Web pages as WARC archives: a sharded writer with the same files for the same pages, and a reader.

Records are in the order of page id. Their byte offsets in that order, found from two levels of sums, cut them into
shards, so shards do not depend on how Spark deals out the work. A shard is written by one task, record by record, into
files that begin anew at a compressed size. Payloads that occur more than once are stored once, the other records revisit
it. Files are written under temporary names of one attempt; a manifest of the attempts that counted moves them to their
final names, and a second manifest, written last, names the archive's files.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import sys
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import batch_of, map_batches, remove_path, stored, stored_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of records of a shard at least, and shards at most; with more bytes shards grow.
SHARD, SHARDS = 32 << 20, 1 << 14
#: Compressed bytes at which the next file of a shard begins.
FILE = 128 << 20
#: Payloads of more than one in so many pages are joined by broadcast: there are at most so many of them.
_HOT = 4096
#: Bytes of a record beside its payload and address, as far as shards are concerned.
_HEAD = 512
_LOWEST = -(1 << 63)
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_LEVEL = 6


def digest(raw: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None, tie: int, copy: int) -> str:
    made = uuid.UUID(bytes=hashlib.md5(f"{page_id}|{tie}|{copy}".encode()).digest(), version=4)
    return f"<urn:uuid:{made}>"


def _address(url: str) -> str:
    """``url`` fit for one header line."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None)]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}".encode(), f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + _END + block + _END) + packer.flush()


def page_record(
    page_id: int | None, tie: int, copy: int, url: str | None, payload: bytes, date: str, refers: tuple[int | None, int] | None
) -> bytes:
    """A response with its payload or, where ``refers`` names another page, a revisit of that."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, tie, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _address(url) if url else None),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page_id),
    ]
    if refers is None:
        return _record(headers, http + payload)
    headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(*refers, 0)), ("X-Refers-To-Page-Id", refers[0])]
    return _record(headers, http)


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive file; raises if a block is not what its digest says."""
    with gzip.GzipFile(fileobj=stream) as plain, io.BufferedReader(plain, 1 << 20) as lines:
        while first := lines.readline():
            if first.strip() != VERSION:
                raise ValueError("no WARC record where one should begin")
            headers: dict[str, str] = {}
            while line := lines.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8").partition(": ")
                headers[name] = value
            block = lines.read(int(headers["Content-Length"]))
            if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}" or lines.read(len(_END)) != _END:
                raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
            yield headers, block


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Files:
    """The files of one task: temporary ones, and a row of the manifest for each."""

    def __init__(self, folder: str, limit: int, date: str) -> None:
        self.system, self.folder = _open(folder)
        self.attempt, self.limit, self.date = uuid.uuid4().hex, limit, date
        self.rows: list[tuple] = []
        self.stream, self.shard, self.number = None, None, 0

    def add(self, shard: int, page_id: int | None, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.stream is not None and self.size >= self.limit:
            self.close()
            self.number += 1
        if self.stream is None:
            self.name = f"part-{shard:05d}-{self.number:05d}.warc.gz"
            self.system.create_dir(f"{self.folder}/{self.attempt}", recursive=True)
            self.stream = self.system.open_output_stream(f"{self.folder}/{self.attempt}/{self.name}", compression=None)
            self.size, self.records, self.sum = 0, 0, hashlib.sha256()
            info = f"software: tabscope\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            kind = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, shard, self.number)), ("WARC-Date", self.date)]
            self._write(_record([*kind, ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
            self.first = page_id
        self._write(record)
        self.records, self.last = self.records + 1, page_id

    def _write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.sum.update(raw)
        self.size += len(raw)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.rows.append((self.name, f"{self.attempt}/{self.name}", self.size, self.records, self.first, self.last, self.sum.hexdigest()))


_MANIFEST = "file string, written string, bytes bigint, records bigint, first_page bigint, last_page bigint, sha256 string"
_ORDER = ["shard", "rank", "tie", "is_page"]


def _writer(folder: str, limit: int, date: str, min_bytes: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, limit, date)
        last, copy, note = None, 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                shard, rank, tie, is_page, page_id, url, payload, to_id, to_tie = (c[row].as_py() for c in batch.columns)
                if not is_page:  # comes before the pages it is about
                    note = (rank, page_id, tie), (to_id, to_tie)
                    continue
                here = (rank, page_id, tie)
                copy = copy + 1 if here == last else 0
                refers = note[1] if note and note[0] == here else None
                if copy and refers is None and len(payload) >= min_bytes:  # the same row once more
                    refers = (page_id, tie)
                files.add(shard, page_id, page_record(page_id, tie, copy, url, payload, date, refers))
                last = here
        files.close()
        if files.rows:
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*files.rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[p.split(" ")[0] for p in _MANIFEST.split(", ")])

    return work


def _notes(thin: DataFrame, min_bytes: int) -> DataFrame:
    """``(page_id, rank, tie, to_id, to_tie)`` of pages whose payload another page keeps."""
    groups = thin.filter(F.col("size") >= min_bytes).groupBy("key").agg(F.count("*").alias("m"), F.max(F.struct("page_id", "tie")).alias("to"))
    groups = groups.filter("m > 1")
    total = thin.count()
    hot = groups.filter(F.col("m") * _HOT > total).select("key", "to")
    # Of the other payloads none has many pages, so none of them makes a large part of a shuffle.
    rest = groups.filter(F.col("m") * _HOT <= total).select("key", "to")
    common = thin.join(F.broadcast(hot), "key", "left")
    found = common.filter("to IS NOT NULL").unionByName(common.filter("to IS NULL").drop("to").join(rest, "key"))
    others = found.filter(~(F.col("to.page_id").eqNullSafe(F.col("page_id")) & (F.col("to.tie") == F.col("tie"))))
    return others.select("page_id", "rank", "tie", F.col("to.page_id").alias("to_id"), F.col("to.tie").alias("to_tie"))


def _shards(thin: DataFrame, shard_bytes: int) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """The shard of a page, by (rank, tie): where its first byte lies among the bytes of all pages in order."""
    dealt = thin.select("rank", "tie", "bytes").repartitionByRange("rank", "tie").sortWithinPartitions("rank", "tie")

    def running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            ends = np.cumsum(sizes) + total
            yield batch_of(part=batch.column(0), rank=batch.column(1), tie=batch.column(2), bytes=batch.column(3), at=pa.array(ends - sizes))
            total = int(ends[-1]) if len(ends) else total

    rows = dealt.select(F.spark_partition_id().alias("part"), "rank", "tie", "bytes")
    placed = stored(map_batches(rows, running, "part int, rank bigint, tie bigint, bytes bigint, at bigint"), "warc-offsets")
    # One row for each task of that job.
    parts = sorted(map(tuple, placed.groupBy("part").agg(F.sum("bytes")).collect()))
    begins = np.cumsum([0, *(n for _, n in parts)])
    size = max(shard_bytes, -(-int(begins[-1]) // SHARDS))
    table = thin.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(parts, begins[:-1], strict=True)], "part int, begin bigint")
    shard = F.floor((F.col("begin") + F.col("at")) / size)
    first = placed.join(F.broadcast(table), "part").groupBy(shard.alias("shard")).agg(F.min(F.struct("rank", "tie")).alias("first"))
    # At most SHARDS + 1 rows.
    starts = sorted((r["first"]["rank"], r["first"]["tie"]) for r in first.collect())

    def shard_of(rank: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(starts, k) - 1 for k in zip(rank.tolist(), tie.tolist(), strict=True)], dtype="int32")

    return shard_of


def write_warc(
    pages: DataFrame, path: str, *, min_bytes: int = 0, shard_bytes: int = SHARD, file_bytes: int = FILE, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes a record for each row of ``pages`` (``page_id``, ``url``, ``html``) into the folder ``path``; returns the manifest.

    The payload is ``html`` in UTF-8, NULL as empty. Of pages with equal payloads of at least ``min_bytes`` bytes the one
    with the largest id is a response (of equal ids the one with the largest hash of address and payload; of rows that are
    all equal the first), the others revisit it. Records go by id, NULL ids first; rows alike in id, address and payload
    stay in one shard, where all but one are short records. Line ends and other control characters of addresses are
    written as %XX. All records bear ``date``. The same rows give the same files, byte for byte.

    ``path`` is a place that pyarrow's file systems open on every machine (``file://`` or a plain path on shared storage,
    ``s3://``, ``hdfs://`` where its library is installed); it may not hold a manifest yet. An empty table gives an empty
    manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    system, folder = _open(path)
    if system.get_file_info(f"{folder}/manifest").type != pafs.FileType.NotFound:
        raise ValueError(f"{path} holds an archive already")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha2("payload", 256))
    rows = rows.withColumns({"key": key, "rank": F.coalesce("page_id", F.lit(_LOWEST))}).withColumn("tie", F.xxhash64("url", "key"))
    size = F.octet_length("payload").cast("bigint")
    bytes_ = size + F.coalesce(F.octet_length("url"), F.lit(0)) + _HEAD
    thin = stored(rows.select("page_id", "rank", "tie", "key", size.alias("size"), bytes_.alias("bytes")), "warc-pages")
    shard_of = F.pandas_udf(_shards(thin, shard_bytes), "int")
    notes = _notes(thin, min_bytes).select("rank", "tie", F.lit(False).alias("is_page"), "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "to_id", "to_tie")
    none = F.lit(None).cast("bigint")
    both = rows.select("rank", "tie", F.lit(True).alias("is_page"), "page_id", "url", "payload", none.alias("to_id"), none.alias("to_tie")).unionByName(notes)
    dealt = both.select(shard_of("rank", "tie").alias("shard"), "*").repartition("shard").sortWithinPartitions("shard", "rank", "page_id", "tie", "is_page")
    temporary = f"{path}/_temporary"
    map_batches(dealt, _writer(f"{temporary}/files", file_bytes, date, min_bytes), _MANIFEST).write.mode("overwrite").parquet(f"{temporary}/manifest")

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for batch in batches:
            for name, written, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                # An earlier attempt of this task may have moved it.
                if system.get_file_info(f"{folder}/_temporary/files/{written}").type == pafs.FileType.File:
                    system.move(f"{folder}/_temporary/files/{written}", f"{folder}/{name}")
                elif system.get_file_info(f"{folder}/{name}").size != n:
                    raise FileNotFoundError(f"{path}/{name}")
            yield batch

    names = [p.split(" ")[0] for p in _MANIFEST.split(", ")]
    map_batches(spark.read.schema(_MANIFEST).parquet(f"{temporary}/manifest").select(names), move, _MANIFEST).drop("written").write.parquet(f"{path}/manifest")
    remove_path(spark, temporary)
    return read_manifest(pages, path)


def read_manifest(like: DataFrame, path: str) -> DataFrame:
    """``(file, bytes, records, first_page, last_page, sha256)`` of the archive in ``path``, for the session of ``like``."""
    return like.sparkSession.read.schema(_MANIFEST.replace("written string, ", "")).parquet(f"{path}/manifest")


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """``(page_id, url, record_type, payload_bytes, payload_digest, refers_to, html)`` of every page of an archive.

    One task reads a file, record by record. ``html`` is NULL for revisits, and an empty or missing address NULL. Raises
    for a block or payload that differs from its digest.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(_END)
                        size = int(next(h for h in http.split(b"\r\n") if h.startswith(b"Content-Length:")).split(b":")[1])
                        known = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or digest(payload) != known):
                            raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                        ids = [int(headers[k]) if k in headers else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        text = payload.decode("utf-8") if kind == "response" else None
                        rows.append((ids[0], headers.get("WARC-Target-URI"), kind, size, known, ids[1], text))
                        held += len(payload)
                        if held > 1 << 22 or len(rows) >= 5_000:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, html string"
    # Few rows that each mean a large file: as many tasks as files, up to the bound of a table's.
    tasks = max(1, min(manifest.count(), SHARDS))
    return map_batches(manifest.select("file").repartition(tasks, "file"), work, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into the shared folder and reads the archive back, without the payloads."""
    path = stored_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
