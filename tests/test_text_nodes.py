"""Texts, nodes, windows and languages: edge rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lakewarden.functions import text as T
from lakewarden.operators import chunks, language, nodes
from lakewarden.plans import text_plans


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in cols.items()])
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("  a ", "a"), ("  a\x1c\n", "a"), ("", ""), (None, None)])
def test_strip(spark, raw, want):
    assert one(spark, T.strip(F.col("t")), t=raw) == want


def test_candidates(spark):
    assert one(spark, T.first_text([F.col("a"), F.col("b")]), a=" \t", b=" x ") == "x"
    assert one(spark, T.first_text([F.col("a")], F.lit("d")), a=None) == "d"
    assert one(spark, T.first_integer([F.col("a"), F.col("b")]), a="3.0", b=3.9) == 3
    assert one(spark, T.first_integer([F.col("a"), F.col("b")]), a=" 3 ", b=9) == 3
    assert one(spark, T.first_integer([F.col("a")], F.lit(7)), a="x") == 7


def test_emails_and_time(spark):
    assert one(spark, T.mask_emails(F.col("t")), t="a+b@mail.x.org, me@x.y, é@ü.de q@w.co") == "@, me@x.y, é@ü.de @"
    assert one(spark, T.mask_emails(F.col("t")), t=None) == ""
    assert one(spark, T.utc_time(F.col("t")), t="1700000000") == "2023-11-14T22:13:20+00:00"
    assert one(spark, T.utc_time(F.col("t")), t="1700000000.0") == "1700000000.0"
    assert one(spark, T.normalize(F.col("t")), t=" a​\x07 \t  b﻿ ") == "a b"


def test_time_beyond_year_9999(spark, tmp_path):
    assert one(spark, T.utc_time(F.col("t")), t="0") == "1970-01-01T00:00:00+00:00"
    assert one(spark, T.utc_time(F.col("t")), t="253402300799") == "9999-12-31T23:59:59+00:00"
    assert one(spark, T.utc_time(F.col("t")), t="253402300800") == "10000-01-01T00:00:00+00:00"
    ids = [1, 2921356, 2921357, 2921360, 5999999, 35999999]
    spark.createDataFrame([(k,) for k in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(text_plans.ORACLES["iso_time"]).fetchall()
    assert len(want) == len(ids) and sorted(map(tuple, text_plans.iso_time(spark, str(tmp_path)).collect())) == sorted(want)


def test_posts_and_comments(spark):
    posts = spark.createDataFrame([("1", "T", "x", None, 5, "1700000000"), ("2", "T", " ", "y", None, None), ("3", " ", None, "", 1, None), ("4", "", "only", None, -1, "now")], "id string, title string, text string, body string, score int, created_utc string")
    out = {r.node_id: r for r in nodes.posts(posts).collect()}
    assert set(out) == {"post:1", "post:2", "post:4"}
    assert out["post:1"].embed_text == "T\n\nx" and out["post:2"].embed_text == "T\n\ny" and out["post:4"].embed_text == "only" and out["post:4"].title is None
    assert out["post:1"].upvotes == 5 and out["post:2"].score == 0 and out["post:1"].created_at == "2023-11-14T22:13:20+00:00"
    comments = spark.createDataFrame([("c1", "hi", "t3_1", 1), ("c2", "yo", "t1_9", None), ("c3", "me", None, 2), ("c4", "  ", "t3_1", 0)], "comment_id string, text string, link_id string, depth int")
    out = {r.node_id: r for r in nodes.comments(comments).collect()}
    assert set(out) == {"comment:c1", "comment:c2", "comment:c3"}
    assert out["comment:c1"].conversation_id == "1" and out["comment:c2"].parent_source_id == "t1_9" and out["comment:c3"].conversation_id == "c3" and out["comment:c3"].parent_source_id is None
    cut = nodes.posts(posts, max_chars=2).filter("node_id = 'post:1'").first()
    assert cut.embed_text == "T\n" and cut.text_sha256 == nodes.posts(posts).filter("node_id = 'post:1'").first().text_sha256


def test_dedup(spark):
    rows = [("a", 1, 0), ("a", 5, 1), ("a", 5, 2), ("b", None, 3), ("b", 0, 4), ("c", -1, 5), ("c", None, 6)]
    out = nodes.dedup_keep_best(spark.createDataFrame(rows, "sha string, score int, ord int"), "sha", "score", "ord").collect()
    assert sorted((r.sha, r.score, r.ord, r.position) for r in out if r.sha != "b") == [("a", 5, 1, 0), ("c", None, 6, 5)]
    assert [(r.ord, r.position) for r in out if r.sha == "b"] == [(3, 3)]


@pytest.mark.parametrize("n, size, overlap", [(0, 4, 1), (4, 4, 1), (5, 4, 1), (10, 4, 1), (7, 3, 5), (100, 16, 4)])
def test_windows(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, "  ".join(words)), (2, None)], "id int, t string")
    got = sorted((r.chunk_index, r.start_token, r.end_token, r.text) for r in chunks.windows(df, "id", "t", size, overlap).filter("id = 1").collect())
    step, want, at = max(1, size - overlap), [], 0
    if n <= size:
        want = [(0, 0, n, "  ".join(words))]
    else:
        while True:
            want.append((len(want), at, min(at + size, n), " ".join(words[at : at + size])))
            if at + size >= n:
                break
            at += step
    assert got == want
    assert {w for _, a, b, _ in got for w in range(a, b)} == set(range(n))
    assert chunks.windows(df, "id", "t", size, overlap).filter("id = 2").count() == 1
    assert chunks.whole(df, "id", "t").count() == 2


def test_language_summary(spark):
    rows = [("tie", "post", 0, "de", 5), ("tie", "post", 1, "en", 5), ("und", "post", 0, "und", 9), ("zero", "post", 0, "und", 0), ("mix", "comment", 0, "en", 9), ("mix", "comment", 1, "fr", 1), ("few", "comment", 0, "en", 91), ("few", "comment", 1, "fr", 9)]
    out = {r.node_id: r for r in language.node_summary(spark.createDataFrame(rows, "node_id string, node_type string, chunk_index long, language string, n_chars long"), mixed_min_frac=0.1).collect()}
    assert out["tie"].dominant_language == "de" and out["tie"].english_char_frac == 0.5 and out["tie"].is_mixed_language
    assert out["und"].dominant_language == "und" and out["und"].dominant_char_frac == 0 and out["zero"].english_char_frac == 0
    assert out["mix"].is_mixed_language and not out["few"].is_mixed_language
    assert out["mix"].lang_char_dist == '{"en":9,"fr":1}'


def test_english_filter(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.49)], "node_id string, english_char_frac double")
    assert [r.node_id for r in language.english_only(df).collect()] == ["b"]
    assert language.english_only(df, enabled=False).count() == 3 and language.english_only(df.drop("english_char_frac")).count() == 3
    again = language.attach(language.attach(df.select("node_id"), df), df)
    assert again.columns == ["node_id", "english_char_frac"] and again.count() == 3
