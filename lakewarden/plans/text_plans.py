"""Queries over texts, nodes, windows and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.functions import text as T
from lakewarden.operators import chunks, language, nodes
from lakewarden.sources.tables import table

#: White space as the engine strips it, for RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def raw_conversations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turn 0 as raw posts, later turns as raw comments."""
    turns = table(spark, folder, "conversations")
    posts = turns.filter("turn = 0").select(F.col("conv_id").alias("id"), F.col("role").alias("title"), F.col("text").alias("body"), F.lit("conv").alias("subreddit"), (F.col("conv_id") % 7).alias("score"))
    comments = turns.filter("turn > 0").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("t3_"), "conv_id").alias("link_id"), "text", F.col("turn").alias("depth"), (F.col("turn") % 3).alias("score"))
    return posts, comments


RAW_SQL = f"""
WITH posts AS (SELECT conv_id::VARCHAR AS source_id, {sql_strip("role")} AS title, {sql_strip("text")} AS body, conv_id % 7 AS score FROM conversations WHERE turn = 0),
pn AS (SELECT 'post:' || source_id AS node_id, source_id AS conversation_id, NULL::VARCHAR AS parent_source_id, 'post' AS node_type, 0::BIGINT AS depth, score,
       concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(body, '')) AS embed_text FROM posts),
comments AS (SELECT conv_id || '-' || turn AS source_id, conv_id::VARCHAR AS parent, {sql_strip("text")} AS body, turn AS depth, turn % 3 AS score FROM conversations WHERE turn > 0),
cn AS (SELECT 'comment:' || source_id AS node_id, parent AS conversation_id, parent AS parent_source_id, 'comment' AS node_type, depth, score, coalesce(body, '') AS embed_text FROM comments),
nodes AS (SELECT * FROM (SELECT * FROM pn UNION ALL SELECT * FROM cn) WHERE embed_text != '')
"""


def node_compose(spark: SparkSession, folder: str) -> DataFrame:
    posts, comments = raw_conversations(spark, folder)
    both = nodes.posts(posts).unionByName(nodes.comments(comments))
    return both.select("node_id", "conversation_id", "parent_source_id", "node_type", "depth", "embed_text", "text_sha256", "upvotes")


def union_posts_comments(spark: SparkSession, folder: str) -> DataFrame:
    return nodes.corpus(*raw_conversations(spark, folder)).select("node_id", "node_type", "text_sha256", "score")


def candidate_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    blank = F.when(F.col("event_id") % 3 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "event_type", F.lit("\n")))
    number = F.when(F.col("event_id") % 4 == 0, F.lit("3.0")).otherwise(F.get_json_object("props", "$.k"))
    return events.select("event_id", T.first_text([blank, F.col("props")]).alias("label"), T.first_integer([number, F.col("value")]).alias("number"))


def iso_time(spark: SparkSession, folder: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 5 == 0, F.lit("1700000000.0")).otherwise((F.col("event_id") * 86399 + 1_000_000_000).cast("string"))
    return table(spark, folder, "events").select("event_id", T.utc_time(stamp).alias("created_at"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def mask_emails(spark: SparkSession, folder: str) -> DataFrame:
    masked = T.mask_emails(F.col("text"))
    return documents(spark, folder).select("doc_id", T.sha256(masked).alias("masked_sha256"), F.char_length(masked).cast("long").alias("n_chars"))


def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    clean = T.normalize(F.concat(F.lit("​\x07 "), F.col("text"), F.lit("\x0b﻿ \n")))
    return documents(spark, folder).select("doc_id", T.sha256(clean).alias("sha256"), T.approximate_tokens(clean).alias("approx_tokens"))


def text_hash(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", T.sha256(F.col("text")).alias("sha256"), nodes.preview(F.col("text")).alias("preview"))


def dedup_keep_best(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", T.sha256(F.col("text")).alias("sha"), (F.col("doc_id") % 7).alias("score"))
    return nodes.dedup_keep_best(docs, "sha", "score", "doc_id").select("doc_id", "sha", "score", "position")


def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    cut = chunks.windows(documents(spark, folder), "doc_id", "text", 128, 16)
    return cut.select("doc_id", "chunk_index", "start_token", "end_token", "n_chars", T.sha256(F.col("text")).alias("sha256"))


WINDOWS_SQL = f"""
WITH t AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{WS.replace("[", "[^", 1)}+') AS w FROM documents),
i AS (SELECT doc_id, lang, text, w, unnest(range(0, CASE WHEN len(w) > SIZE THEN ceil((len(w) - SIZE) / STEP)::BIGINT + 1 ELSE 1 END)) AS i FROM t),
c AS (SELECT doc_id, lang, i AS chunk_index, i * STEP AS start_token, least(i * STEP + SIZE, len(w))::BIGINT AS end_token,
      CASE WHEN len(w) > SIZE THEN array_to_string(w[i * STEP + 1:i * STEP + SIZE], ' ') WHEN len(w) = 0 THEN '' ELSE text END AS text FROM i)
"""


def windows_sql(size: int, overlap: int) -> str:
    return WINDOWS_SQL.replace("SIZE", str(size)).replace("STEP", str(size - overlap))


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    """Windows with a stand-in detector: every fourth window is English, others have the document's language."""
    docs = documents(spark, folder)
    cut = chunks.windows(docs, "doc_id", "text", 32, 8).join(docs.select("doc_id", "lang"), "doc_id")
    found = F.when(F.col("chunk_index") % 4 == 3, "en").otherwise(F.col("lang"))
    kind = F.when(F.col("doc_id") % 3 == 0, "post").otherwise("comment")
    return cut.select(F.col("doc_id").alias("node_id"), kind.alias("node_type"), "chunk_index", language.window_language(found, F.col("n_chars"), 160).alias("language"), "n_chars")


DETECTED_SQL = windows_sql(32, 8) + """,
d AS (SELECT doc_id AS node_id, CASE WHEN doc_id % 3 = 0 THEN 'post' ELSE 'comment' END AS node_type, chunk_index, length(text)::BIGINT AS n_chars,
      CASE WHEN length(text) < 160 THEN 'und' WHEN chunk_index % 4 = 3 THEN 'en' ELSE coalesce(lang, 'und') END AS language FROM c),
l AS (SELECT node_id, node_type, language, sum(n_chars)::BIGINT AS chars, min(chunk_index) AS first FROM d GROUP BY ALL),
n AS (SELECT node_id, node_type, sum(chars)::BIGINT AS n_chars, coalesce(sum(chars) FILTER (WHERE language = 'en'), 0)::BIGINT AS english,
      string_agg('"' || language || '":' || chars, ',' ORDER BY chars DESC, first, language) AS dist FROM l GROUP BY ALL),
b AS (SELECT * FROM (SELECT node_id, language, chars, row_number() OVER (PARTITION BY node_id ORDER BY chars DESC, first, language DESC) AS r FROM l WHERE language != 'und') WHERE r = 1),
m AS (SELECT l.node_id, count(*) FILTER (WHERE l.language != 'und' AND l.chars / greatest(n.n_chars, 1) >= 0.1::DOUBLE) > 1 AS mixed FROM l JOIN n USING (node_id) GROUP BY ALL),
s AS (SELECT n.node_id, n.node_type, coalesce(b.language, 'und') AS dominant_language, coalesce(b.chars / greatest(n.n_chars, 1), 0) AS dominant_char_frac, n.english / greatest(n.n_chars, 1) AS english_char_frac,
      m.mixed AS is_mixed_language, n.n_chars, '{' || n.dist || '}' AS lang_char_dist FROM n LEFT JOIN b USING (node_id) JOIN m USING (node_id))
"""


def node_language_summary(spark: SparkSession, folder: str) -> DataFrame:
    return language.node_summary(_detected(spark, folder))


def language_distribution(spark: SparkSession, folder: str) -> DataFrame:
    found = _detected(spark, folder)
    summary = language.node_summary(found).select("node_type", F.col("dominant_language").alias("language"), "n_chars")
    return language.distribution(found, "chunk").unionByName(language.distribution(summary, "node_dominant"))


def _distribution_sql(scope: str, source: str, lang: str) -> str:
    return f"""SELECT '{scope}' AS scope, CASE WHEN g = 1 THEN 'all' ELSE node_type END AS node_type, language, n_units, round_even(n_units * 100.0::DOUBLE / sum(n_units) OVER (PARTITION BY g, node_type), 4) AS pct_units, n_chars,
    round_even(n_chars * 100.0::DOUBLE / nullif(sum(n_chars) OVER (PARTITION BY g, node_type), 0), 4) AS pct_chars
    FROM (SELECT node_type, {lang} AS language, count(*) AS n_units, sum(n_chars)::BIGINT AS n_chars, grouping(node_type) AS g FROM {source} GROUP BY GROUPING SETS (({lang}), ({lang}, node_type)))"""


def english_filter(spark: SparkSession, folder: str) -> DataFrame:
    summary = language.node_summary(_detected(spark, folder))
    docs = documents(spark, folder).select(F.col("doc_id").alias("node_id"), "source")
    return language.english_only(language.attach(docs, summary)).select("node_id", "source", "dominant_language", "english_char_frac")


def language_counters(spark: SparkSession, folder: str) -> DataFrame:
    return language.counters(language.node_summary(_detected(spark, folder)))


def trigger_language(spark: SparkSession, folder: str) -> DataFrame:
    found = _detected(spark, folder)
    scored = documents(spark, folder).select(F.col("doc_id").alias("node_id"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4 * 2).alias("trigger_chunk_index"))
    return language.trigger_language(scored, found).select("node_id", "trigger_language")


QUERIES = {f.__name__: f for f in (
    node_compose, union_posts_comments, candidate_coalesce, iso_time, mask_emails, text_normalize, text_hash, dedup_keep_best, token_windows, node_language_summary, language_distribution, english_filter, language_counters, trigger_language,
)}

ORACLES = {
    "node_compose": RAW_SQL + "SELECT node_id, conversation_id, parent_source_id, node_type, depth, embed_text, sha256(embed_text) AS text_sha256, score AS upvotes FROM nodes",
    "union_posts_comments": RAW_SQL + "SELECT node_id, node_type, sha256(embed_text) AS text_sha256, score FROM (SELECT *, row_number() OVER (PARTITION BY node_type, embed_text ORDER BY score DESC, node_id) AS r FROM nodes) WHERE r = 1",
    "candidate_coalesce": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE event_type END AS label, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE try_cast(json_extract_string(props, '$.k') AS BIGINT) END, trunc(value)::BIGINT) AS number FROM events""",
    "iso_time": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '1700000000.0' ELSE strftime(make_timestamp((event_id * 86399 + 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS created_at FROM events",
    "mask_emails": r"SELECT doc_id, sha256(m) AS masked_sha256, length(m)::BIGINT AS n_chars FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '@', 'g') AS m FROM documents)",
    "text_normalize": f"""SELECT doc_id, sha256(t) AS sha256, (length(t) // 4)::BIGINT AS approx_tokens FROM (SELECT doc_id, {sql_strip("regexp_replace(x, '" + WS + "+', ' ', 'g')")} AS t FROM (SELECT doc_id,
        regexp_replace(regexp_replace({sql_strip(r"chr(8203) || chr(7) || ' ' || text || chr(11) || chr(65279) || ' ' || chr(10)")}, '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}\\x{{feff}}]', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS x FROM documents))""",
    "text_hash": "SELECT doc_id, sha256(text) AS sha256, left(text, 200) AS preview FROM documents",
    "dedup_keep_best": "SELECT doc_id, sha256(text) AS sha, doc_id % 7 AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id % 7 DESC, doc_id) AS r, min(doc_id) OVER (PARTITION BY text) AS position FROM documents) WHERE r = 1",
    "token_windows": windows_sql(128, 16) + "SELECT doc_id, chunk_index, start_token, end_token, length(text)::BIGINT AS n_chars, sha256(text) AS sha256 FROM c",
    "node_language_summary": DETECTED_SQL + "SELECT * FROM s",
    "language_distribution": DETECTED_SQL + _distribution_sql("chunk", "d", "language") + " UNION ALL " + _distribution_sql("node_dominant", "s", "dominant_language"),
    "english_filter": DETECTED_SQL + "SELECT node_id, source, dominant_language, english_char_frac FROM s JOIN documents ON node_id = doc_id WHERE english_char_frac >= 0.5",
    "language_counters": DETECTED_SQL + "SELECT count(*) AS n_nodes, count(*) FILTER (WHERE dominant_language != 'en') AS n_non_english, count(*) FILTER (WHERE is_mixed_language) AS n_mixed, count(*) FILTER (WHERE dominant_language = 'en') AS n_english FROM s",
    "trigger_language": DETECTED_SQL + "SELECT x.doc_id AS node_id, coalesce(d.language, 'und') AS trigger_language FROM documents x LEFT JOIN d ON d.node_id = x.doc_id AND d.chunk_index = x.doc_id % 4 * 2",
}
