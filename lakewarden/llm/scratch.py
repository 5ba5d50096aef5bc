"""Intermediate tables of the training-data operators, in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lakewarden.sources.staging import delete, new_path as unused_path, shared_folder

__all__ = ["discard", "discarding", "new_path", "shared_folder", "stage", "stage_kept"]

#: Paths made inside each open :func:`discarding`, innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = unused_path(spark, label)
    if _open:
        _open[-1].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Starts a job. The files live as long as the folder; :func:`discard` or an
    open :func:`discarding` drops them earlier.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_kept(df: DataFrame, label: str) -> DataFrame:
    """As :func:`stage`, for a result that outlives an open :func:`discarding`."""
    path = unused_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`stage`."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        delete(df.sparkSession, folder)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside is deleted at the end: for the inner tables of a result that is written itself by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)
