"""The folder that all machines of a cluster can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the session's checkpoint folder if that was set in code.

    A session of one process that has neither gets a checkpoint folder of its own; a cluster session has to name one.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"{_SETTING} has to name a folder that the whole cluster can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabscope-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _storable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        names = [f.name.lower() for f in kind]
        return len(set(names)) == len(names) and all(_storable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType, T.UserDefinedType))


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written right away below the shared folder and read again, for steps that read it several times.

    The files stay until whoever clears the folder removes them. A table that Parquet cannot hold stays as it is.
    """
    if not df.columns or not _storable(df.schema):
        return df
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
