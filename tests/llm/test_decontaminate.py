"""Decontamination: automaton against plain search, cuts, blocks of items."""

import random

from pyspark.sql import functions as F

from lakewarden.llm import decontaminate
from lakewarden.llm.automaton import SuffixAutomaton

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def plain_hits(text, items, window):
    hit, found = set(), set()
    for item, words in items.items():
        runs = [words[k : k + window] for k in range(len(words) - window + 1)] if len(words) >= window else [words] if words else []
        for run in runs:
            for s in range(len(text) - len(run) + 1):
                if text[s : s + len(run)] == run:
                    found.add(item)
                    hit |= set(range(s, s + len(run)))
    return hit, found


def test_automaton_against_search():
    dice = random.Random(2)
    for _ in range(600):
        window, letters = dice.choice([1, 2, 3, 4, 10]), dice.choice([1, 2, 3, 5])
        items = {i: [dice.randrange(letters) for _ in range(dice.randrange(14))] for i in range(dice.randrange(8))}
        automaton = SuffixAutomaton(window)
        for item, words in items.items():
            automaton.add(item, words)
        automaton.finish()
        text = [dice.randrange(-1, letters) for _ in range(dice.randrange(40))]
        spans, found = automaton.find(text)
        assert ({x for a, b in spans for x in range(a, b)}, found) == plain_hits(text, items, window)


def tables(spark):
    dice = random.Random(4)
    say = lambda n: [f"W{dice.randrange(12)}" for _ in range(n)]
    items = [(i, " ".join(say(dice.choice([1, 3, 9, 10, 11, 30])))) for i in range(3, 20)] + [(20, None), (21, ""), (22, "...")]
    items = [(i, t if i != 3 else "Über_ÉCLAIR x") for i, t in items]
    long = [t for _, t in items if t and len(t.split()) >= 10]
    texts = [None, "", "_", "über éCLAIR x", "Über-ÉCLAIR,X y", *long]
    for _ in range(60):
        words = [f"n{dice.randrange(50)}" for _ in range(dice.randrange(60))]
        words[len(words) // 2 : 0] = dice.choice(long).split()[: dice.choice([5, 9, 10, 40])]
        texts.append(dice.choice([" ", ", ", "_\n"]).join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, None, None, None, None)], SCHEMA)
    return docs, spark.createDataFrame(items, ITEMS), texts, items


def words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_documents(spark):
    docs, bench, texts, items = tables(spark)
    want = {i: words(t) for i, t in items}
    for block_words in (10**6, 25):
        out = decontaminate.contamination(docs.withColumn("items", F.lit("own")), bench.withColumn("spans", F.lit(1)), block_words=block_words).collect()
        assert len(out) == len(texts) + 1
        for r in out:
            hit, found = plain_hits(words(texts[r.doc_id]), want, 10)
            assert {x for a, b in zip(r.spans[::2], r.spans[1::2]) for x in range(a, b)} == hit
            assert set(r["items"]) == {str(i) for i in found} and r.n_words == len(words(texts[r.doc_id]))
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_removal_leaves_no_window(spark):
    docs, bench, texts, items = tables(spark)
    long = bench.filter("length(text) > 25")
    out = decontaminate.remove_contamination(docs, long, length_col="n_chars")
    assert out.columns == docs.columns or set(out.columns) == set(docs.columns)
    rows = out.collect()
    want = {i: words(t) for i, t in items if t and len(t) > 25}
    before = {i: plain_hits(words(t), want, 10)[0] for i, t in enumerate(texts)}
    for r in rows:
        assert not plain_hits(words(r.text), want, 10)[0]
        if not before[r.doc_id]:
            assert r.text == texts[r.doc_id]
    assert {r.doc_id for r in rows} >= {i for i, h in before.items() if not h}
    assert all(len(before[i]) > 0.5 * len(words(t)) for i, t in enumerate(texts) if i not in {r.doc_id for r in rows})


def test_removal_by_blocks_is_that_of_one_block(spark):
    docs, bench, _, _ = tables(spark)
    item = lambda name: [f"{name}{k}" for k in range(10)]
    plain = [f"q{k}" for k in range(100)]
    names = "abcdefgh"
    halves = [" ".join([*plain[:14], *item(x), *item(y)]) for x in names for y in names if x < y]
    # cutting y brings the halves of x together
    split = [" ".join([*plain, *item(x)[:5], *item(y), *item(x)[5:]]) for x in names for y in names if x != y]
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate([*halves, *split])], SCHEMA)
    items = spark.createDataFrame([(100 + i, " ".join(item(x))) for i, x in enumerate(names)], ITEMS)
    for given, against in ((docs, bench.filter("length(text) > 25")), (more, items), (more, items.limit(0))):
        want, got = ([tuple(r) for r in decontaminate.remove_contamination(given, against, length_col="n_chars", block_words=n).select(*docs.columns).collect()] for n in (10**6, 25))
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_segments_are_searched_alike(spark, monkeypatch):
    docs, bench, _, _ = tables(spark)
    read = lambda: sorted((r.doc_id, r.n_words, tuple(r.spans), tuple(sorted(r["items"]))) for r in decontaminate.contamination(docs, bench).collect())
    want = read()
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 40)
    assert read() == want


def test_clashing_names_and_missing_ids(spark):
    """Columns of any name pass; an item without an id counts, but has no place among the ids."""
    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, "x " * 40 + text, "a", "b"), (2, text, "c", "d"), (None, "clean", "e", "f")], "doc_id long, text string, before string, _row string")
    for name in ("after", "stays", "total", "hit", "spans", "state", "row", "cut", "n_words", "items"):
        docs = docs.withColumn(name, F.col("before"))
    bench = spark.createDataFrame([(None, text), (7, text)], ITEMS)
    for block_words in (10**6, 13):
        out = decontaminate.remove_contamination(docs, bench, block_words=block_words)
        rows = {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and set(rows) == {1, None} and rows[1].text == "x " * 40 and rows[1].cut == "a" and rows[None].text == "clean"
        found = {r.doc_id: r["items"] for r in decontaminate.contamination(docs, bench, block_words=block_words).collect()}
        assert all(sorted(found[k], key=str) == ["7", None] for k in (1, 2)) and found[None] == []
    assert decontaminate.remove_contamination(docs.limit(0), bench).count() == 0
