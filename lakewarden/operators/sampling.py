"""Samples, splits and folds ordered by a hash of seed and id: deterministic, engine-independent, no generator state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def draw(seed: int | str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def simple(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are fewer (a top-n, so no full sort)."""
    return df.orderBy(draw(seed, key), key).limit(n)


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each stratum. Spark keeps n rows a task before shuffling (window group limit)."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, key), key))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def placed(df: DataFrame, key: str, stratum: str, seed: int = 42) -> DataFrame:
    """Adds ``_place`` (from 1, by hash) and ``_size`` of each row's stratum.

    One stratum may hold nearly all rows, so it is cut into 256 slices by the
    first digits of the hash: slices are counted by an ordinary aggregate, and a
    window ranks the rows of one slice only.
    """
    own = F.coalesce(F.concat(F.lit("0"), F.col(stratum).cast("string")), F.lit("1"))
    rows = df.withColumns({"_k": own, "_h": draw(seed, key)}).withColumn("_s", F.substring("_h", 1, 2))
    along = Window.partitionBy("_k").orderBy("_s")
    counts = rows.groupBy("_k", "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_k", "_s", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_k")).alias("_size"))
    within = F.row_number().over(Window.partitionBy("_k", "_s").orderBy("_h", key))
    return rows.join(counts, ["_k", "_s"]).withColumn("_place", F.col("_before") + within).select(*df.columns, "_place", "_size")


def split(df: DataFrame, key: str, stratum: str, test_fraction: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: in each stratum the first half-even-rounded fraction by hash is test, the rest train."""
    size = F.bround(F.col("_size") * F.lit(float(test_fraction)), 0)
    return placed(df, key, stratum, seed).select(*df.columns, F.when(F.col("_place") <= size, "test").otherwise("train").alias("split"))


def folds(df: DataFrame, key: str, stratum: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: in each stratum, place by hash modulo k."""
    return placed(df, key, stratum, seed).select(*df.columns, ((F.col("_place") - 1) % k).cast("long").alias("fold"))


def fold_coverage(assigned: DataFrame, k: int, required: str, stratum: str = "severity") -> DataFrame:
    """One row a fold 0..k-1: rows, rows of the required stratum, and whether the fold is usable."""
    every = assigned.sparkSession.range(k).select(F.col("id").alias("fold"))
    counted = assigned.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col(stratum) == required).alias("n_required"))
    filled = every.join(counted, "fold", "left").na.fill(0, ["n", "n_required"])
    return filled.withColumn("ok", (F.col("n") > 0) & (F.col("n_required") > 0))


def same_assignment(left: DataFrame, right: DataFrame, columns: Sequence[str] = ("node_id", "severity", "fold")) -> bool:
    """Whether two assignments hold the same rows, in any order. Starts jobs."""
    a, b = left.select(*columns), right.select(*columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def reconcile(fresh: DataFrame, stored: DataFrame | None, overwrite: bool = False) -> DataFrame:
    """The stored assignment if it equals the fresh one; the fresh one if none is stored or ``overwrite``; else an error."""
    if stored is None or overwrite:
        return fresh
    if same_assignment(fresh, stored):
        return stored
    raise ValueError("a different fold assignment is stored; pass overwrite to replace it")
