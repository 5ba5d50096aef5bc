"""Readers with the edge rules of the text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lakewarden.functions.text import strip


def parquet(spark: SparkSession, path: str, columns: Sequence[str] = (), optional: Sequence[str] = ()) -> DataFrame:
    """Named columns, and those optional ones that the schema has."""
    df = spark.read.parquet(path)
    return df.select(*columns, *[c for c in optional if c in df.columns]) if columns else df


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, blanks kept as empty strings; quoted newlines and doubled quotes are one cell."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).na.fill("")


def csv_typed(spark: SparkSession, path: str, schema: str | StructType, columns: Sequence[str] = ()) -> DataFrame:
    """A declared schema (no pass to infer one), optionally some of its columns."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines by a declared schema; blank lines are skipped, lines that are no JSON give nulls."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids one a line, stripped, blank lines dropped; a repeated id is an error (starts a job)."""
    from lakewarden.operators.contracts import require_unique

    ids = spark.read.text(path).select(strip(F.col("value")).alias("node_id")).filter("node_id != ''")
    require_unique(ids, "node_id")
    return ids


def id_table(spark: SparkSession, path: str, hash_col: str = "text_sha256") -> DataFrame:
    """Ids of a CSV with a column node_id, and its hash column if it has one; blank ids go, a repeated id is an error (starts a job)."""
    from lakewarden.operators.contracts import require_columns, require_unique

    rows = csv_text(spark, path)
    named = require_columns(rows, ["node_id", *([hash_col] if hash_col in rows.columns else [])])
    ids = named.withColumn("node_id", strip(F.col("node_id"))).filter("node_id != ''")
    require_unique(ids, "node_id")
    return ids


def if_exists(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """The table, or an empty one of the schema where nothing is stored yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.format(format).schema(schema).load(path)


def checkpoints(paths: DataFrame, path: str = "path") -> DataFrame:
    """(epoch, path) of head checkpoints among file names, in numeric order."""
    epoch = F.regexp_extract(path, r"head_epoch(\d+)\.pt$", 1)
    return paths.filter(epoch != "").select(epoch.cast("long").alias("epoch"), F.col(path)).orderBy("epoch")


def last_checkpoint(found: DataFrame) -> DataFrame:
    """The checkpoint of the last epoch, decided before any is evaluated."""
    return found.agg(F.max_by(F.struct("epoch", "path"), "epoch").alias("c")).filter("c is not null").select("c.*")


def prompt(text: str | None, what: str = "prompt") -> str:
    """A prompt's text, stripped; missing or empty is an error."""
    if not text or not text.strip():
        raise ValueError(f"{what} is missing or empty")
    return text.strip()
