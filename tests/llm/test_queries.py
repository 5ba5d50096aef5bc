"""Registered training-data queries over whole small tables: SQL where it can, brute force elsewhere."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from lakewarden.llm import registry
from tests.llm.test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(x):
    return ("nan" if math.isnan(x) else f"{x:.6f}") if isinstance(x, float) else str(x)


def test_registered():
    names = registry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 11)) and len(names) == 10
    assert {*names, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, views, name):
    df = registry.queries()[name](spark, FOLDER)
    rows, columns = df.collect(), sorted(df.columns)
    want = views.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[k]) for k in places) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_mixing", "op10_quality"])
def test_native(spark, name):
    text = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_simhash_query(spark, views):
    docs = views.sql("SELECT doc_id, text FROM documents").fetchall()
    want = {d: plain_fingerprint(t) for d, t in docs}
    roots = dict(plain_components(list(want.items())))
    out = registry.queries()["op5_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {d: (f"{want[d]:016x}", roots[d]) for d, _ in docs} and len(out) == len(docs)


def test_tokens_query(spark, views):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for d, t in views.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in registry.queries()["op7_tokens"](spark, FOLDER).collect()) == want


def test_html_query(spark, views):
    import html

    want = {}
    for page, source in views.sql("SELECT page_id, html FROM pages").fetchall():
        inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", inside)]
        want[page] = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
    out = registry.queries()["op8_html"](spark, FOLDER).collect()
    assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)


def test_chat_query(spark, views):
    """The derived events reach every status, so links, levels and schemas act on the table."""
    out = registry.queries()["op9_chat"](spark, "/root/testdata/sf0.01").collect()
    text = " ".join(r.message for r in out)
    assert all(f'"status":"{s}"' in text for s in ("linked", "unanswered", "duplicate", "orphan", "cyclic"))
    assert any(r.n_invalid for r in out) and '"level":2' in text
