"""Writers: overwrite guards, fixed headers, partitioned output, manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.operators.contracts import content_hash


#: Cells as they are: quotes doubled, blanks at either end kept, missing ones empty.
CSV = {"header": True, "escape": '"', "quote": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Refuses an existing target unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, overwrite: bool = False, single: bool = False) -> None:
    """A fixed header, missing cells empty, quotes doubled; ``single`` for small reports only."""
    out = df.select(*columns) if columns else df
    out = out.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite" if overwrite else "errorifexists").options(**CSV).csv(path)


def json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One object a row (a single text column is taken as it is)."""
    lines = df if len(df.columns) == 1 else df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def by_severity(df: DataFrame, path: str, block: str, overwrite: bool = True) -> None:
    """Folders text/severity=<n> with rendered blocks and csv/severity=<n> with the rows; what a folder held before goes.

    Without columns beside the severity and the block there are no rows to write.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    df.select("severity", F.col(block).alias("value")).write.mode(mode).partitionBy("severity").text(f"{path}/text")
    others = [c for c in df.columns if c not in ("severity", block)]
    if not others:
        return
    rows = df.select("severity", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in others])
    rows.write.mode(mode).partitionBy("severity").options(**CSV).csv(f"{path}/csv")


def id_list(df: DataFrame, path: str, key: str = "node_id", overwrite: bool = False) -> None:
    df.select(F.col(key).cast("string").alias("value")).orderBy("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def append_rows(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Durable progress: every call adds a batch, as Parquet, CSV (a header in every file) or JSON lines."""
    df.write.mode("append").format(format).options(**(CSV if format == "csv" else {})).save(path)


def environment(spark: SparkSession, packages: Sequence[str] = ("pyspark", "pyarrow", "pandas", "numpy")) -> dict:
    """Versions of Spark, Java, Python and packages, and the settings that results depend on; what cannot be told is null."""
    import platform
    from importlib import metadata

    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    java = spark.sparkContext._jvm.java.lang.System.getProperty("java.version")
    return {"spark": spark.version, "java": java, "python": platform.python_version(), "packages": {p: version(p) for p in packages}, "settings": settings}


def merge_manifest(old: dict, new: dict) -> dict:
    """Nested dictionaries merge, other values replace."""
    merged = dict(old)
    for key, value in new.items():
        merged[key] = merge_manifest(merged[key], value) if isinstance(value, dict) and isinstance(merged.get(key), dict) else value
    return merged


def manifest(spark: SparkSession, tables: dict[str, DataFrame], config: dict, timings: dict[str, float] | None = None) -> dict:
    """Configuration, environment, timings and content hashes of the named tables (data, folds). Starts a job a table."""
    hashes = {name: {"n_rows": r.n_rows, "hash": str(r.hash_sum)} for name, df in tables.items() if (r := content_hash(df).first())}
    return {"created_at": datetime.now(timezone.utc).isoformat(), "environment": environment(spark), "config": config, "inputs": hashes, "timings": timings or {}}


def manifest_text(content: dict) -> str:
    return json.dumps(content, indent=2, sort_keys=True, default=str)
