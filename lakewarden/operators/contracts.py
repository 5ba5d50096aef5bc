"""Runtime contracts as relational checks. Functions that raise start small jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """A table breaks a contract; the message has a few examples."""


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_none(bad: DataFrame, what: str, examples: int = 20) -> None:
    if rows := bad.limit(examples).collect():
        raise ContractError(f"{what}: {[tuple(r) for r in rows]}")


def require_unique(df: DataFrame, *keys: str) -> None:
    require_none(duplicates(df, *keys), f"repeated {', '.join(keys)}")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; missing ones are an error, others go."""
    if len(set(names)) != len(names):
        raise ContractError("expected columns repeat")
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns: {missing}")
    return df.select(*names)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which neither side repeats a key and every left row matches, else an error."""
    require_unique(left, key)
    require_unique(right, key)
    require_none(left.join(right, key, "left_anti").select(key), "unmatched rows")
    return left.join(right, key)


def one_to_one_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The same contract as one row of counts: n_left, n_left_repeated, n_right_repeated, n_unmatched, ok."""
    counts = left.agg(F.count("*").alias("n_left"), (F.count("*") - F.count_distinct(key)).alias("n_left_repeated"))
    counts = counts.crossJoin(right.agg((F.count("*") - F.count_distinct(key)).alias("n_right_repeated"))).crossJoin(left.join(right, key, "left_anti").agg(F.count("*").alias("n_unmatched")))
    return counts.withColumn("ok", (F.col("n_left_repeated") == 0) & (F.col("n_right_repeated") == 0) & (F.col("n_unmatched") == 0))


def set_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """sha256 of the sorted ids, one a line. The ids meet in one row: for evaluation sets, not for corpora."""
    return df.agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(key).cast("string"))), "\n"), 256).alias("fingerprint"), F.count_distinct(key).alias("n"))


def content_hash(df: DataFrame) -> DataFrame:
    """Order-independent fingerprint of a table of any size: row count and the sum of row hashes, as ordinary partial aggregates."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"))


def hash_mismatches(df: DataFrame, text: str, expected: str) -> DataFrame:
    """Rows whose text does not have the expected sha256."""
    return df.filter(~F.sha2(F.coalesce(F.col(text), F.lit("")), 256).eqNullSafe(F.col(expected)))


def text_mismatches(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose texts differ between two tables (null equals empty, a missing row is empty)."""
    a, b = left.select(key, F.coalesce(text, F.lit("")).alias("_a")), right.select(key, F.coalesce(text, F.lit("")).alias("_b"))
    return a.join(b, key, "left").filter(F.col("_a") != F.coalesce("_b", F.lit(""))).select(key)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids only left, only right, in both."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"))


def probabilities_ok(df: DataFrame, p: str) -> Column:
    """Aggregate: non-empty, finite and within [0, 1] everywhere."""
    return (F.count("*") > 0) & (F.count_if(F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)) == 0)


def filter_or_all(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows that meet the predicate, or all rows if none does: one plan, decided by a count of matches joined back as one row."""
    counted = df.agg(F.count_if(predicate).alias("_matches"))
    return df.crossJoin(F.broadcast(counted)).filter(predicate | (F.col("_matches") == 0)).drop("_matches")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if not df.limit(1).count():
        raise ContractError(f"{what}: no rows")
    return df
