"""Overlapping windows of tokens, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The native tokenizer: runs of characters that are no white space.
TOKEN = r"(?U)\S+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def windows(df: DataFrame, key: str, text: str, chunk_tokens: int, overlap: int) -> DataFrame:
    """(key, chunk_index, start_token, end_token, text, n_chars): one row a window; nothing is shuffled.

    No token gives one empty window; up to ``chunk_tokens`` tokens give one
    window with the text as it is; else windows start every
    max(1, chunk_tokens - overlap) tokens and end with the first that reaches
    the last token, their tokens joined by spaces.
    """
    step = max(1, chunk_tokens - overlap)
    base = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), tokens(F.col(text)).alias("_tokens"))
    n = F.size("_tokens")
    last = F.when(n > chunk_tokens, F.ceil((n - chunk_tokens) / step)).otherwise(0).cast("int")
    cut = base.select(key, "_text", "_tokens", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.when(F.size("_tokens") > chunk_tokens, F.col("chunk_index") * step).otherwise(0)
    end = F.least(start + chunk_tokens, F.size("_tokens"))
    words = F.when(F.size("_tokens") > chunk_tokens, F.array_join(F.slice("_tokens", start + 1, F.lit(chunk_tokens)), " ")).when(F.size("_tokens") == 0, "").otherwise(F.col("_text"))
    return cut.select(key, F.col("chunk_index").cast("long"), start.cast("long").alias("start_token"), end.cast("long").alias("end_token"), words.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def whole(df: DataFrame, key: str, text: str) -> DataFrame:
    """With chunking off: one pseudo window (0, 0) for every row."""
    zero = F.lit(0).cast("long")
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(key, zero.alias("chunk_index"), zero.alias("start_token"), zero.alias("end_token"), body.alias("text"), F.char_length(body).cast("long").alias("n_chars"))
