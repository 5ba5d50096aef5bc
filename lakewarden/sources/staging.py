"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions without a shared one.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the session is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # The setting cannot be changed in a running session, so the folder is kept here.
        folder = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lakewarden-")
        _own[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lakewarden/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors. Starts a job."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_dealt(df: DataFrame, label: str, key: str) -> DataFrame:
    """As :func:`stage`, with the rows dealt anew by ``key`` to other files in another order.

    How many tasks write follows from the size of the table: AQE cuts what is dealt to its advisory size, rows of one key too
    where they come from several tasks.
    """
    return stage(df.hint("rebalance", key), label)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`stage`."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        delete(df.sparkSession, folder)
