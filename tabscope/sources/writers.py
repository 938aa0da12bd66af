"""Cleansed files, scraped tables and stored profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.scalars import ref


def write_cleansed(df: DataFrame, path: str) -> int:
    """CSV with a header; returns the number of rows, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return seen.get["rows"]


def write_tables(cells: DataFrame, path: str, *, folder_per_table: bool = True) -> None:
    """Scraped rows as headerless CSV, one folder per page and table, led by the row's index.

    Rows are padded to the width of their own table. For more tables than a file system likes folders,
    ``folder_per_table=False`` puts page and table in front of each row.
    """
    table = Window.partitionBy("page_id", "table_index")  # the rows of one table of one page
    sized = cells.withColumn("_width", F.max(F.size("cells")).over(table))
    spare = F.array_repeat(F.lit(""), F.col("_width") - F.size("cells"))
    lead = [F.col("row_index").cast("string")]
    if not folder_per_table:
        lead = [F.col(c).cast("string") for c in ("page_id", "table_index", "row_index")]
    row = F.concat(F.array(*lead), F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), spare)
    quoted = F.transform(
        row, lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    )
    ordered = sized.sortWithinPartitions("page_id", "table_index", "row_index")
    line = F.array_join(quoted, ",").alias("value")
    if folder_per_table:
        ordered.select("page_id", "table_index", line).write.mode("errorifexists").partitionBy("page_id", "table_index").text(path)
    else:
        ordered.select(line).write.mode("errorifexists").text(path)


#: The store of profiles, whatever the documents hold: they are JSON text, ``kind`` says by which schema.
STORE_VERSION = 1
_STORE = "_id string, file_id string, version int, kind string, document string, created_at timestamp, project_id string"


def append_profile(profile: DataFrame, file_id: str, project_id: str, path: str) -> None:
    """Adds the documents of a profile to the store, with their ids and the time, into the folder of their project."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profile.schema)
    profile.select(
        F.uuid().alias("_id"),
        F.lit(file_id).alias("file_id"),
        F.lit(STORE_VERSION).alias("version"),
        F.lit(kind).alias("kind"),
        F.to_json(F.struct(*[ref(c) for c in profile.columns])).alias("document"),
        F.current_timestamp().alias("created_at"),
        F.lit(project_id).alias("project_id"),
    ).write.mode("append").partitionBy("project_id").parquet(path)


def find_profiles(
    spark: SparkSession, path: str, file_id: str | None = None, project_id: str | None = None
) -> DataFrame:
    """``(_id, file_id, project_id, metadata, created_at)``: stored documents of a file or project.

    The project picks folders, the file id reaches the file reader. Profiles of several kinds may stand in one store:
    ``metadata`` has the fields of all kinds that are found, which are looked up right away.
    """
    found = spark.read.schema(_STORE).parquet(path)
    if file_id:
        found = found.filter(F.col("file_id") == file_id)
    if project_id:
        found = found.filter(F.col("project_id") == project_id)
    return _opened(found)


def profile_by_id(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    return _opened(spark.read.schema(_STORE).parquet(path).filter(F.col("_id") == document_id))


def _opened(found: DataFrame) -> DataFrame:
    kinds = [r["kind"] for r in found.select("kind").distinct().collect()]  # one for each shape of a profile
    fields: dict[str, T.StructField] = {}
    for kind in sorted(kinds):
        for f in T.StructType.fromDDL(kind):
            fields[f.name] = T.StructField(f.name, _both(fields[f.name].dataType, f.dataType) if f.name in fields else f.dataType)
    shape = T.StructType(list(fields.values())) if fields else T.StructType([T.StructField("column", T.StringType())])
    metadata = F.from_json("document", shape).alias("metadata")
    return found.select("_id", "file_id", "project_id", metadata, "created_at")


def _both(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that reads both; fields of that name with types of different kinds are read as text."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = {f.name: f.dataType for f in a}
        for f in b:
            names[f.name] = _both(names[f.name], f.dataType) if f.name in names else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in names.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_both(a.elementType, b.elementType))
    return a if a == b else T.StringType()
