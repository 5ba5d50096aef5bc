"""Scanning nodes: windows scored against prototypes or references, one result row a node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakewarden.operators import nodes as N, vectors as V
from lakewarden.operators.report import last_of

TRIGGER = ("start_token", "end_token", "text")


def _rows(best: DataFrame, nodes: DataFrame, nearest: dict[str, Column], thresholds: Sequence[float]) -> DataFrame:
    """Best windows with their node's fields; a node without a window has no row."""
    passed = [c for c in ("upvotes", "downvotes", "score", "depth", "reply_count", "submolt_name", "created_at") if c in nodes.columns]
    known = N.result_fields(nodes.select("node_id", "node_type", *passed, N.preview(F.col("embed_text")).alias("text_preview")))
    trigger = {"trigger_start_token": F.col("start_token"), "trigger_end_token": F.col("end_token"), "trigger_chunk_text": F.col("text"), "threshold_flags": F.to_json(V.threshold_flags(F.col("max_similarity"), thresholds))}
    return best.withColumns(nearest | trigger).drop(*TRIGGER).join(known, "node_id")


def contrast(windows: DataFrame, prototypes: DataFrame, nodes: DataFrame, thresholds: Sequence[float], labels: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """windows (node_id, chunk_index, start_token, end_token, text, vector) by contrast; the two sides are the top list."""
    scored = V.contrast_scores(windows, "vector", prototypes).withColumnRenamed("score", "_score")
    best = V.max_chunk(scored, "node_id", "_score", "chunk_index", ["sim_malicious", "sim_benign", *TRIGGER])
    side, known = V.nearest_label(F.col("max_similarity")), labels or {}
    pick = lambda k: F.when(side == "malicious", known.get("malicious", ("malicious", "contrast"))[k]).otherwise(known.get("benign", ("benign", "contrast"))[k])
    nearest = {
        "nearest_threat_id": side, "nearest_category": pick(0), "nearest_source": pick(1), "topk_threat_ids": F.lit('["malicious","benign"]'), "topk_scores": F.to_json(F.array("sim_malicious", "sim_benign")),
    }
    return _rows(best, nodes, nearest, thresholds)


def nearest(windows: DataFrame, references: DataFrame, nodes: DataFrame, k: int, thresholds: Sequence[float], labels: DataFrame | None = None) -> DataFrame:
    """Windows by their k nearest references (threat_id, vector): example mode, or cluster mode with centres for references.

    labels (threat_id, category, source) is looked up for the nearest one, the last row of a repeated id; without a match both are empty.
    """
    keyed = windows.withColumn("_window", F.concat_ws("#", "node_id", "chunk_index"))
    top = V.top_k(keyed, "_window", references, "threat_id", "vector", k)
    lists = top.groupBy("_window").agg(F.sort_array(F.collect_list(F.struct("rank", "threat_id", "similarity"))).alias("t"))
    scored = keyed.drop("vector").join(lists, "_window").withColumn("_score", F.get("t.similarity", F.lit(0)))
    best = V.max_chunk(scored, "node_id", "_score", "chunk_index", ["t", *TRIGGER])
    found = {"nearest_threat_id": F.get("t.threat_id", F.lit(0)), "topk_threat_ids": F.to_json("t.threat_id"), "topk_scores": F.to_json("t.similarity")}
    rows = _rows(best, nodes, found, thresholds).drop("t")
    if labels is None:
        return rows.withColumns({"nearest_category": F.lit(""), "nearest_source": F.lit("")})
    named = last_of(labels, "threat_id", "category", "source").select(F.col("threat_id").alias("nearest_threat_id"), F.struct("category", "source").alias("l"))
    filled = {"nearest_category": F.coalesce("l.category", F.lit("")), "nearest_source": F.coalesce("l.source", F.lit(""))}
    return rows.join(named, "nearest_threat_id", "left").withColumns(filled).drop("l")
