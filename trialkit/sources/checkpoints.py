"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_folders: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may fall back to one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _own_folders:
        _own_folders[sc.applicationId] = tempfile.mkdtemp(prefix="trialkit-")
        logging.getLogger(__name__).warning(
            "spark.checkpoint.dir is not set; intermediate tables go to %s on this machine", _own_folders[sc.applicationId]
        )
    return _own_folders[sc.applicationId]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table below the shared folder.

    It is removed when the program ends, or by :func:`discard`, whatever has been written there.
    """
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read on from there.

    The table is columnar, so later steps read the columns they use, and it is removed when the program
    ends (or by :func:`discard`, once nothing reads it any more).
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*[_as_before(f) for f in df.schema.fields])


def _as_before(field: T.StructField) -> Column:
    """A file's columns are all nullable; those that held no NULL say so again, which keeps joins on them plain."""
    column = F.col("`" + field.name.replace("`", "``") + "`")
    if field.nullable:
        return column
    if isinstance(field.dataType, T.NumericType):
        return F.coalesce(column, F.lit(0).cast(field.dataType)).alias(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(column, F.lit("")).alias(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return F.coalesce(column, F.lit(False)).alias(field.name)
    return column


def discard(spark: SparkSession | None = None) -> None:
    """Remove the tables written so far (by this session); results that read them must be done with."""
    left = []
    for session, path in _written:
        if spark is not None and session is not spark:
            left.append((session, path))
            continue
        try:
            target = session._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; its cluster clears the folder
            logging.getLogger(__name__).info("left %s", path)
    _written[:] = left


atexit.register(discard)
