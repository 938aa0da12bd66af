"""Profiles that grow with a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabscope.functions.reshape import long_numbers
from tabscope.functions.scalars import Names, as_list, field_type, known, numeric_columns, ref
from tabscope.sources.shared import fresh_path


def stream_profile(
    stream: DataFrame, columns: Names | None = None, *, points: tuple[float, ...] = (), accuracy: int = 10_000
) -> DataFrame:
    """Running ``(column, finite_count, total, total_squares, mean, standard_deviation, minimum, maximum)``.

    State is one row per column. ``points`` adds approximate quantiles, whose state is bounded too.
    """
    names = as_list(columns) or numeric_columns(stream)
    value = F.col("value")
    extra: list[Column] = []
    if points:
        extra.append(F.percentile_approx(value, list(points), accuracy).alias("quantiles"))
    return (
        long_numbers(stream, names)
        .groupBy("column")
        .agg(
            F.count(value).alias("finite_count"),
            F.sum(value).alias("total"),
            F.sum(value * value).alias("total_squares"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("standard_deviation"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
            *extra,
        )
    )


def stream_value_counts(stream: DataFrame, column: str) -> DataFrame:
    """Running ``(<column>, count)`` of present values."""
    field_type(stream, column)
    present = stream.select(known(stream, column).alias(column)).filter(ref(column).isNotNull())
    return present.groupBy(ref(column)).agg(F.count(F.lit(1)).alias("count"))


def start_running(
    result: DataFrame, path: str, *, available_now: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Keeps the newest states of a running aggregation below ``path``, one folder for each of the last two batches.

    A batch that is run again after a failure rewrites its own folder, so results appear once.
    """
    writer = (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{path}/progress")
        .foreachBatch(_replace(f"{path}/state"))
    )
    chosen = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return chosen.start()


def _replace(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        # The state before stays for whoever is reading it.
        _drop(batch.sparkSession, f"{path}/batch={number - 2}")

    return write


def read_running(result: DataFrame, path: str) -> DataFrame:
    """The newest stored state; empty when no batch has been written."""
    spark = result.sparkSession
    stored = spark.read.schema(f"{_ddl(result)}, batch bigint").parquet(f"{path}/state")
    newest = stored.agg(F.max("batch")).scalar()
    return stored.filter(F.col("batch") == newest).drop("batch")


def start_changes(
    result: DataFrame, path: str, *, available_now: bool = True, interval: str = "1 minute"
) -> StreamingQuery:
    """Writes the rows of a running aggregation that a batch has changed, below ``path``, one folder for each batch.

    A batch costs what it changes, however many keys there are. One that is run again after a failure rewrites its own
    folder. :func:`read_changes` has the newest row of every key, :func:`merge_changes` makes reading cheap again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    writer = result.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").foreachBatch(write)
    chosen = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return chosen.start()


def _since(result: DataFrame, path: str) -> tuple[DataFrame, int | None]:
    """The last merged table and all changes after it, each row with its batch; and the batch up to which it is merged."""
    spark, schema = result.sparkSession, f"{_ddl(result)}, batch bigint"
    changes = spark.read.schema(schema).parquet(f"{path}/changes")
    merged = _folders(spark, f"{path}/merged")
    if not merged:
        return changes, None
    upto = max(int(name.split("=")[1]) for name in merged)
    before = spark.read.schema(_ddl(result)).parquet(f"{path}/merged/upto={upto}").withColumn("batch", F.lit(upto).cast("bigint"))
    return before.unionByName(changes.filter(F.col("batch") > upto)), upto


def read_changes(result: DataFrame, keys: Names, path: str) -> DataFrame:
    """The newest row of every key."""
    rows, _ = _since(result, path)
    names = as_list(keys)
    rest = [c for c in result.columns if c not in names]
    newest = rows.groupBy(*[ref(k) for k in names]).agg(F.max_by(F.struct(*[ref(c) for c in rest]), "batch").alias("_row"))
    return newest.select(*[ref(c) if c in names else F.col("_row").getField(c).alias(c) for c in result.columns])


def merge_changes(result: DataFrame, keys: Names, path: str) -> None:
    """Puts all changes so far into one table and drops them, while no batch is running."""
    spark = result.sparkSession
    rows, upto = _since(result, path)
    newest = rows.agg(F.max("batch")).first()[0]
    if newest is None or newest == upto:
        return
    read_changes(result, keys, path).write.mode("overwrite").parquet(f"{path}/merged/upto={newest}")
    # From here on the changes up to that batch are not read any more.
    for name in _folders(spark, f"{path}/changes"):
        if int(name.split("=")[1]) <= newest:
            _drop(spark, f"{path}/changes/{name}")
    if upto is not None:
        _drop(spark, f"{path}/merged/upto={upto}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Finished tables below a folder: one for each batch not yet merged, or each merged one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [p.getName() for p in found if files.exists(done(p, "_SUCCESS"))]


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def run_to_end(result: DataFrame, name: str) -> DataFrame:
    """Runs a running aggregation over everything there is and returns the final state."""
    path = fresh_path(result.sparkSession, name)
    start_running(result, path).awaitTermination()
    return read_running(result, path)


def run_changes_to_end(result: DataFrame, keys: Names, name: str) -> DataFrame:
    """Runs a running aggregation over everything there is, batch by batch, and returns the newest row of every key."""
    path = fresh_path(result.sparkSession, name)
    start_changes(result, path).awaitTermination()
    return read_changes(result, keys, path)
