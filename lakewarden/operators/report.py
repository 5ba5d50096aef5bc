"""Reports: threshold sweep, review strata, top matches, conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lakewarden.operators import sampling

# The review strata, half-open; scores outside are in none.
STRATA = (("high_confidence", 0.55, 1.01), ("mid_confidence", 0.50, 0.55), ("borderline", 0.45, 0.50), ("near_miss", 0.40, 0.45), ("negative_control", 0.00, 0.40))


def stratum(score):
    label = F.lit(None).cast("string")
    for name, lo, hi in STRATA:
        label = F.when((score >= lo) & (score < hi), name).otherwise(label)
    return label


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], score: str = "max_similarity", category: str = "nearest_category") -> DataFrame:
    """threshold, flagged_count, flagged_pct, post_count, comment_count, categories (map): all thresholds in one pass.

    The scored table is summed by (type, category) for every threshold at once;
    only that small sum is unpivoted.
    """
    cells = scored.groupBy("node_type", category).agg(F.count("*").alias("n"), *[F.count_if(F.col(score) >= t).alias(f"t{k}") for k, t in enumerate(thresholds)])
    wide = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("hits")) for k, t in enumerate(thresholds)])
    long = cells.select("node_type", F.col(category).alias("category"), "n", F.explode(wide).alias("t")).select("node_type", "category", "n", "t.*")
    by_category = long.filter("hits > 0").groupBy("threshold", "category").agg(F.sum("hits").alias("hits")).groupBy("threshold").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "hits")))).alias("categories"))
    counted = long.groupBy("threshold").agg(
        F.sum("hits").alias("flagged_count"), F.sum("n").alias("total"), F.sum(F.when(F.col("node_type") == "post", F.col("hits")).otherwise(0)).alias("post_count"), F.sum(F.when(F.col("node_type") == "comment", F.col("hits")).otherwise(0)).alias("comment_count"),
    )
    pct = F.when(F.col("total") > 0, F.bround(F.col("flagged_count") * 100.0 / F.col("total"), 4)).otherwise(0.0)
    out = counted.join(by_category, "threshold", "left")
    return out.select("threshold", "flagged_count", pct.alias("flagged_pct"), "post_count", "comment_count", F.coalesce(F.to_json("categories"), F.lit("{}")).alias("categories_json"))


def strata_sample(scored: DataFrame, n: int, score: str = "max_similarity", key: str = "node_id", seed: int = 42) -> DataFrame:
    """Up to n rows of every stratum; scores in none of them are left out."""
    labelled = scored.withColumn("stratum", stratum(F.col(score))).filter("stratum is not null")
    return sampling.stratified(labelled, key, "stratum", n, seed)


def unassigned(scored: DataFrame, score: str = "max_similarity") -> DataFrame:
    return scored.agg(F.count_if(stratum(F.col(score)).isNull()).alias("n_unassigned"))


def last_of(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row a key with the values of its last row in the order in which the table is read."""
    numbered = df.select(key, F.struct(*values).alias("_v"), F.monotonically_increasing_id().alias("_n"))
    return numbered.groupBy(key).agg(F.max_by("_v", "_n").alias("_v")).select(key, "_v.*")


def top_matches(scored: DataFrame, n: int, nodes: DataFrame | None = None, dictionary: DataFrame | None = None, score: str = "max_similarity") -> DataFrame:
    """The n best rows with rank, and title, text and nearest_attack_text where their tables are given (null columns elsewhere).

    A top-n keeps n rows a task; only those are joined. Of a threat_id that the
    dictionary repeats, the last row counts.
    """
    best = scored.orderBy(F.col(score).desc(), "node_id").limit(n)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), "node_id")))
    if nodes is not None:
        best = best.join(nodes.select("node_id", "title", F.substring("text", 1, 220).alias("text")), "node_id", "left")
    else:
        best = best.withColumns({"title": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    if dictionary is not None:
        last = last_of(dictionary, "threat_id", "attack_text")
        return best.join(last.select(F.col("threat_id").alias("nearest_threat_id"), F.substring("attack_text", 1, 160).alias("nearest_attack_text")), "nearest_threat_id", "left")
    return best.withColumn("nearest_attack_text", F.lit(None).cast("string"))


def flagged_conversations(scored: DataFrame, nodes: DataFrame, cutoff: float, score: str = "max_similarity") -> DataFrame:
    """Nodes at or above the cutoff rolled up by conversation, lists in order of node id; nodes without a conversation are left out.

    submolt_name is the first non-empty one in that order. A conversation's
    list is its output row, so it is gathered by design.
    """
    flagged = scored.filter(F.col(score) >= cutoff).select("node_id", F.col(score).alias("_s"))
    rows = flagged.join(nodes.select("node_id", "node_type", "conversation_id", "submolt_name"), "node_id").filter("conversation_id is not null")
    named = F.when(F.coalesce("submolt_name", F.lit("")) != "", F.struct("node_id", "submolt_name"))
    rolled = rows.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "node_type", "_s"))).alias("f"), F.min(named).alias("first"), F.count("*").alias("n_flagged"))
    return rolled.select(
        "conversation_id", F.concat(F.lit("post:"), "conversation_id").alias("post_node_id"), F.coalesce("first.submolt_name", F.lit("")).alias("submolt_name"), "n_flagged",
        F.col("f.node_id").alias("flagged_node_ids"), F.col("f.node_type").alias("flagged_node_types"), F.col("f._s").alias("flagged_scores"),
    )


def without_conversation(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many scored nodes have no conversation (the warning count)."""
    known = nodes.filter("conversation_id is not null").select("node_id")
    return scored.join(known, "node_id", "left_anti").agg(F.count("*").alias("n_missing"))


def conversation_stats(rolled: DataFrame) -> DataFrame:
    return rolled.agg(F.count("*").alias("n_conversations"), F.count_if(F.col("n_flagged") > 1).alias("n_multi_flagged"), F.coalesce(F.max("n_flagged"), F.lit(0)).alias("max_flagged"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts with zeros filled in; the column values are named, so no job looks for them."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counted = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)
    return counted if n is None else counted.limit(n)
