"""Stupid backoff against plain counting, whatever the blocks and partitions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import ngram_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(texts, order=2):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    count = Counter(tuple(d[i : i + k]) for k in range(1, order + 1) for d in docs for i in range(len(d) - k + 1))
    total = sum(map(len, docs))

    def score(gram):
        if len(gram) == 1:
            return math.log10(count[gram] / total), 0
        if count[gram] >= 2:
            return math.log10(count[gram] / count[gram[:-1]]), 0
        lower, steps = score(gram[1:])
        return lower + math.log10(0.4), steps + 1

    for d in docs:
        found = [score(tuple(d[max(0, i - order + 1) : i + 1])) for i in range(len(d))]
        yield len(d), sum(n for _, n in found), sum(s for s, _ in found)


@pytest.mark.parametrize("order, block_words, part_grams, least_entries", [(2, 10**6, 10**6, 16), (2, 40, 37, 0), (2, 40, 37, 10**9), (3, 40, 37, 0), (3, 500, 37, 10**9), (4, 200, 100, 0), (1, 40, 37, 0)])
def test_scores(spark, monkeypatch, order, block_words, part_grams, least_entries):
    """Packed or as rows, in one block or many: the same scores."""
    monkeypatch.setattr(ngram_lm, "SLICE_BYTES", 100)
    monkeypatch.setattr(ngram_lm, "LEAST_ENTRIES", least_entries)
    monkeypatch.setattr(ngram_lm, "PIECE", 64)
    dice = random.Random(8)
    texts = [None, "", " \n ", "A a A", "É é x", " lead and trail \t", "the " * 30000]
    texts += [" ".join(dice.choice(["the", "cat", "sat", "on", "mat", f"w{dice.randrange(99)}"]) for _ in range(dice.randrange(60))) for _ in range(80)]
    texts += texts[3:5]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3).withColumn("block", F.lit("own"))
    out = ngram_lm.scores(docs, order=order, block_words=block_words, part_grams=part_grams).collect()
    want = list(plain(texts, order))
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for r in out:
        n, back, s = want[r.doc_id]
        assert (r.n_words, r.n_backoff) == (n, back) and r.log_score == pytest.approx(s, abs=1e-6)
    assert ngram_lm.scores(docs.limit(0)).count() == 0
