"""Text files to typed tables."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions import fixed
from tabscope.functions.reshape import per_column
from tabscope.functions.scalars import NUMBER_TEXT, literal, quoted, ref, string_columns
from tabscope.sources.csv_records import csv_records

_WHOLE_TEXT = r"^\s*[+-]?\d{1,19}\s*$"
_TRUTH_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"
_SPARE = "_beyond"
SNIFFED_CHARACTERS = 1024
SEPARATORS = (",", ";", "\t", "|")


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    encoding: str | None = None,
    missing: Sequence[str] = fixed.MISSING_TEXTS,
    with_order: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """A CSV file with a header, typed by its content.

    Rows with too many cells are left out, short ones are padded. ``with_order`` adds ``_order``,
    the position in the files, for operators that follow row order. Without ``encoding``, files that are not all
    UTF-8 are read as Latin-1. Quoted cells may hold line breaks: one reading looks for them, and where there are any, each
    task puts the records of its part of a file together (see :mod:`tabscope.sources.csv_records`), so large files are read
    by many tasks. ``multi_line=False`` spares that look, ``multi_line=True`` reads every file in one task as Spark does,
    which files need whose lines end in a lone carriage return.
    """
    encoding = encoding or text_encoding(spark, path)
    options = {"header": True, "sep": sep, "encoding": encoding, "quote": '"', "escape": '"'}
    names = spark.read.options(**options, multiLine=multi_line is not False).csv(path).columns  # reads the header line
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _SPARE]])
    records = csv_records(spark, path, sep, encoding) if multi_line is None else None
    place = [F.col("path").alias("file"), F.col("block"), F.col("place").alias("line")]
    if records is not None:
        cells = F.from_csv("record", schema.toDDL(), {"sep": sep, "quote": '"', "escape": '"'})
        raw = records.select(F.struct(*place).alias("_order"), cells.alias("_cells")).select("_order", "_cells.*")
    else:
        # The filter asks for the spare cell, so it is parsed whatever columns are read later.
        read = spark.read.options(**options, multiLine=bool(multi_line), mode="PERMISSIVE", enforceSchema=True).schema(schema)
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        order = F.struct(*place, F.monotonically_increasing_id().alias("line")).alias("_order")
        raw = read.csv(path).select(order, "*") if with_order else read.csv(path)
    kept = raw.filter(F.col(_SPARE).isNull())
    cells = [F.when(~ref(n).isin(*missing), ref(n)).alias(n) for n in names]
    return narrow_types(kept.select(*cells, *(["_order"] if with_order else [])))


def narrow_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the narrowest of whole number, number and truth value that fits.

    The types decide the schema, so one aggregation over all columns runs right away.
    """
    texts = string_columns(df)
    if not texts:
        return df
    parts = []
    for name in texts:
        text, present = quoted(name), f"count({quoted(name)})"
        whole = f"count(IF({text} RLIKE r'{_WHOLE_TEXT}', try_cast(trim({text}) AS BIGINT), NULL))"
        number = f"count_if({text} RLIKE r'{NUMBER_TEXT}' OR lower(trim({text})) IN {_NON_FINITE})"
        truth = f"count_if({text} RLIKE '{_TRUTH_TEXT}')"
        fits = (
            f"CASE WHEN {present} = 0 THEN 'double' WHEN {whole} = {present} THEN 'bigint' "
            f"WHEN {number} = {present} THEN 'double' WHEN {truth} = {present} THEN 'boolean' END"
        )
        parts.append({"column": literal(name), "type": fits})
    found = {r["column"]: r["type"] for r in per_column(df, parts).collect()}  # one row per column
    return df.select(
        *[_cast(ref(c), found[c]).alias(c) if found.get(c) else ref(c) for c in df.columns]
    )


# Texts that read as a number without being finite.
_NON_FINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def _cast(column: Column, target: str) -> Column:
    return F.trim(column).try_cast(target)


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is, else Latin-1, which any bytes are; looked up right away."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def read_csv_for_profile(
    spark: SparkSession, path: str, *, encoding: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """A CSV file whose separator is the more frequent of comma and semicolon; few texts mean missing."""
    encoding = encoding or text_encoding(spark, path)
    head = _head_text(spark, path, encoding)
    sep = ";" if head.count(";") > head.count(",") else ","
    return read_csv(
        spark, path, sep=sep, encoding=encoding, missing=fixed.PROFILE_MISSING_TEXTS, multi_line=multi_line
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    *,
    encoding: str | None = None,
    with_order: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """A text table; the separator is found in the first lines when none is given."""
    encoding = encoding or text_encoding(spark, path)
    sep = sep or sniff_separator(_head_text(spark, path, encoding))
    return read_csv(spark, path, sep=sep, encoding=encoding, with_order=with_order, multi_line=multi_line)


def sniff_separator(text: str) -> str:
    """The candidate that cuts most lines into the same number of fields, more than one."""
    lines = [line for line in text.splitlines() if line.strip()]
    best, best_score = SEPARATORS[0], (0.0, 0)
    for sep in SEPARATORS:
        widths = Counter(len(row) for row in csv.reader(lines, delimiter=sep))
        if not widths:
            continue
        width, hits = widths.most_common(1)[0]
        score = (hits / len(lines), width)
        if width > 1 and score > best_score:
            best, best_score = sep, score
    return best


def _head_text(spark: SparkSession, path: str, encoding: str) -> str:
    """About the first kilobyte of the data, whole lines only."""
    lines = spark.read.option("encoding", encoding).csv(
        path, schema="value string", sep="\u0001", quote="", escape=""
    )
    text = ""
    for row in lines.limit(64).toLocalIterator():  # bounded: 64 lines
        if text and len(text) + len(row["value"] or "") > SNIFFED_CHARACTERS:
            break
        text += (row["value"] or "") + "\n"
    return text


def read_json_document(spark: SparkSession, path: str, *, encoding: str = "UTF-8") -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.json(path, multiLine=True, encoding=encoding)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def stream_json_lines(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines as a stream of the files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def read_table(spark: SparkSession, path: str, *, encoding: str | None = None) -> DataFrame:
    """A data set by its file extension: csv, json or txt."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension == "csv":
        return read_csv(spark, path, encoding=encoding)
    if extension == "json":
        return read_json_document(spark, path, encoding=encoding or "UTF-8")
    if extension == "txt":
        return read_delimited(spark, path, encoding=encoding)
    raise ValueError(f"Unsupported file type: {extension or path}")


def with_file_order(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table with ``_order``, the position of each row in its files."""
    return spark.read.format(fmt).load(path).select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_order"),
    )
