"""Posts and comments to one table of nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lakewarden.functions import text as T

# Columns in which a logical field may stand, by preference.
POST = {
    "id": ("id", "post_id"), "text": ("text", "body", "selftext", "content"), "created": ("created_utc", "created_at", "timestamp"), "author": ("author", "author_id", "user_id"),
    "community": ("subreddit", "submolt_name", "submolt", "community"), "replies": ("num_comments", "reply_count", "comment_count"),
}
COMMENT = {
    "id": ("id", "comment_id"), "text": ("text", "body", "content", "comment"), "created": ("created_utc", "created_at", "timestamp"), "author": ("author", "author_id", "user_id"),
    "parent": ("post_id", "link_id", "parent_id", "submission_id"), "depth": ("depth", "level"), "replies": ("num_replies", "reply_count"),
}
COLUMNS = ("node_id", "conversation_id", "parent_source_id", "node_type", "source_id", "author_id", "submolt_name", "created_at", "title", "depth", "score", "upvotes", "downvotes", "reply_count", "text", "embed_text", "text_sha256")


def _have(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def _text(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    return T.first_text(_have(df, names), None if default is None else F.lit(default)) if _have(df, names) else F.lit(default).cast("string")


def _whole(df: DataFrame, names: Sequence[str], default: Column) -> Column:
    return T.first_integer(_have(df, names), default) if _have(df, names) else default


def _votes(df: DataFrame) -> dict[str, Column]:
    none = F.lit(0).cast("long")
    score = _whole(df, ("score",), none)
    return {"score": score, "upvotes": _whole(df, ("ups", "upvotes"), score), "downvotes": _whole(df, ("downs", "downvotes"), none)}


def posts(df: DataFrame, max_chars: int = 0) -> DataFrame:
    """Raw posts to nodes; posts with neither title nor text go. The hash is of the uncut text."""
    base = df.select(
        _text(df, POST["id"], "").alias("source_id"), _text(df, ("title",), "").alias("title"), _text(df, POST["text"], "").alias("text"), T.utc_time(_text(df, POST["created"])).alias("created_at"),
        _text(df, POST["author"]).alias("author_id"), _text(df, POST["community"]).alias("submolt_name"), _whole(df, POST["replies"], F.lit(0).cast("long")).alias("reply_count"), *[c.alias(k) for k, c in _votes(df).items()],
    )
    whole = T.compose(F.lit("post"), F.col("title"), F.col("text"))
    made = base.withColumns({
        "node_id": F.concat(F.lit("post:"), "source_id"), "conversation_id": F.col("source_id"), "parent_source_id": F.lit(None).cast("string"), "node_type": F.lit("post"), "depth": F.lit(0).cast("long"),
        "text_sha256": T.sha256(whole), "embed_text": T.cut(whole, max_chars), "title": F.nullif("title", F.lit("")),
    })
    return made.filter("embed_text != ''").select(*COLUMNS)


def comments(df: DataFrame, max_chars: int = 0) -> DataFrame:
    """Raw comments to nodes; a comment's parent is its post, without the ``t3_`` prefix, and its conversation too, or its own id."""
    parent = F.nullif(F.regexp_replace(_text(df, COMMENT["parent"], ""), "^t3_", ""), F.lit(""))
    base = df.select(
        _text(df, COMMENT["id"], "").alias("source_id"), _text(df, COMMENT["text"], "").alias("text"), T.utc_time(_text(df, COMMENT["created"])).alias("created_at"), _text(df, COMMENT["author"]).alias("author_id"),
        parent.alias("parent_source_id"), _whole(df, COMMENT["depth"], F.lit(0).cast("long")).alias("depth"), _whole(df, COMMENT["replies"], F.lit(0).cast("long")).alias("reply_count"), *[c.alias(k) for k, c in _votes(df).items()],
    )
    made = base.withColumns({
        "node_id": F.concat(F.lit("comment:"), "source_id"), "conversation_id": F.coalesce("parent_source_id", "source_id"), "node_type": F.lit("comment"), "submolt_name": F.lit(None).cast("string"), "title": F.lit(None).cast("string"),
        "text_sha256": T.sha256(F.col("text")), "embed_text": T.cut(F.col("text"), max_chars),
    })
    return made.filter("embed_text != ''").select(*COLUMNS)


def dedup_keep_best(df: DataFrame, hash_col: str, score_col: str, order_col: str) -> DataFrame:
    """One row for each hash: the highest score (null counts 0), the earliest of equals; ``position`` is the group's first place.

    ``max_by`` over one shuffle with map-side combining; a hash with any number
    of copies costs one row a task.
    """
    own = [c for c in df.columns if c != "position"]
    best = F.max_by(F.struct(*own), F.struct(F.coalesce(F.col(score_col), F.lit(0)), -F.col(order_col)))
    kept = df.groupBy(hash_col).agg(best.alias("_row"), F.min(order_col).alias("position"))
    return kept.select("_row.*", "position")


def corpus(raw_posts: DataFrame, raw_comments: DataFrame) -> DataFrame:
    """Nodes of both kinds, deduplicated within each kind and never across, then united. Rows stand in order of node id."""

    def kept(nodes: DataFrame) -> DataFrame:
        ranked = Window.partitionBy("text_sha256").orderBy(F.coalesce("score", F.lit(0)).desc(), "node_id")
        return nodes.withColumn("_place", F.row_number().over(ranked)).filter("_place = 1").drop("_place")

    return kept(posts(raw_posts)).unionByName(kept(comments(raw_comments)))


def result_fields(df: DataFrame) -> DataFrame:
    """Node columns that pass through a scan: null text becomes empty, null or bad numbers 0."""
    texts, numbers = ("submolt_name", "created_at"), ("upvotes", "downvotes", "score", "depth", "reply_count")
    clean = {c: F.coalesce(F.col(c), F.lit("")) for c in texts if c in df.columns} | {c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)) for c in numbers if c in df.columns}
    return df.withColumns(clean)


def preview(text: Column, chars: int = 200) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the named columns that exist, in the given order."""
    return df.select(*[n for n in names if n in df.columns])
