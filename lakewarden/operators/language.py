"""Languages of windows summed up by node, reported and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"


def window_language(language: Column, n_chars: Column, min_chars: int) -> Column:
    """Windows shorter than ``min_chars`` are not detected."""
    return F.when(n_chars < min_chars, UNKNOWN).otherwise(F.coalesce(language, F.lit(UNKNOWN)))


def node_summary(chunks: DataFrame, english: str = "en", mixed_min_frac: float = 0.1) -> DataFrame:
    """chunks (node_id, node_type, chunk_index, language, n_chars) to one row a node.

    dominant_language has most characters among detected ones, the language seen
    first winning ties, or ``und`` if none is; fractions are of all characters,
    undetected ones included (a total of 0 counts as 1).
    """
    by_lang = chunks.groupBy("node_id", "node_type", "language").agg(F.sum("n_chars").alias("chars"), F.min("chunk_index").alias("first"))
    known = F.col("language") != UNKNOWN
    entry = F.struct(F.col("chars"), (-F.col("first")).alias("first"), F.col("language"))
    dist = F.sort_array(F.collect_list(F.struct((-F.col("chars")).alias("k"), "first", "language", "chars")))
    node = by_lang.groupBy("node_id", "node_type").agg(
        F.sum("chars").alias("n_chars"), F.max(F.when(known, entry)).alias("top"), F.sum(F.when(F.col("language") == english, F.col("chars")).otherwise(0)).alias("english"),
        F.collect_list(F.when(known, F.col("chars"))).alias("detected"), dist.alias("dist"),
    )
    total = F.greatest("n_chars", F.lit(1))
    mixed = F.size(F.filter("detected", lambda c: c / F.greatest(F.col("n_chars"), F.lit(1)) >= mixed_min_frac)) > 1
    return node.select(
        "node_id", "node_type", F.coalesce("top.language", F.lit(UNKNOWN)).alias("dominant_language"), F.coalesce(F.col("top.chars") / total, F.lit(0.0)).alias("dominant_char_frac"), (F.col("english") / total).alias("english_char_frac"),
        mixed.alias("is_mixed_language"), F.col("n_chars").cast("long"), F.to_json(F.map_from_entries(F.transform("dist", lambda d: F.struct(d["language"], d["chars"])))).alias("lang_char_dist"),
    )


def distribution(units: DataFrame, scope: str) -> DataFrame:
    """Units and characters by language, over all and by node type: one pass with grouping sets, shares by a window over the small result."""
    sets = units.groupingSets([["language"], ["language", "node_type"]], "language", "node_type")
    counted = sets.agg(F.count("*").alias("n_units"), F.sum("n_chars").cast("long").alias("n_chars"), F.grouping("node_type").alias("g"))
    group = Window.partitionBy("node_type", "g")
    share = lambda c: F.when(F.sum(c).over(group) > 0, F.bround(F.col(c) * 100.0 / F.sum(c).over(group), 4))
    return counted.select(F.lit(scope).alias("scope"), F.when(F.col("g") == 1, "all").otherwise(F.col("node_type")).alias("node_type"), "language", "n_units", share("n_units").alias("pct_units"), "n_chars", share("n_chars").alias("pct_chars"))


def counters(summary: DataFrame, english: str = "en") -> DataFrame:
    """One row: nodes, non-English, mixed, English-dominant."""
    return summary.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("dominant_language") != english).alias("n_non_english"), F.count_if("is_mixed_language").alias("n_mixed"), F.count_if(F.col("dominant_language") == english).alias("n_english"))


def english_only(nodes: DataFrame, min_frac: float = 0.5, enabled: bool = True) -> DataFrame:
    """Keeps nodes of at least ``min_frac`` English characters; off, or without the column, keeps all."""
    if not enabled or "english_char_frac" not in nodes.columns:
        return nodes
    return nodes.filter(F.coalesce("english_char_frac", F.lit(0.0)) >= min_frac)


def attach(nodes: DataFrame, summary: DataFrame) -> DataFrame:
    """Left join of the summary; columns of an earlier attachment are replaced."""
    new = [c for c in summary.columns if c not in ("node_id", "node_type")]
    return nodes.drop(*new).join(summary.drop("node_type"), "node_id", "left")


def trigger_language(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Language of the window that gave a node its score (window 0 if none is named), else ``und``."""
    right = chunks.select(F.col("node_id").alias("_n"), F.col("chunk_index").alias("_c"), F.col("language").alias("_l"))
    joined = scored.join(right, (F.col("node_id") == F.col("_n")) & (F.coalesce("trigger_chunk_index", F.lit(0)) == F.col("_c")), "left")
    return joined.withColumn("trigger_language", F.coalesce("_l", F.lit(UNKNOWN))).drop("_n", "_c", "_l")
