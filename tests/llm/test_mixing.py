"""Mixing: targets against a plain loop, takes against targets, edge cases."""

import random

import pytest

from lakewarden.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    left, free, got = share * sum(sizes.values()), set(keys), {}
    while free:
        unit = left / sum(weight[k] for k in free)
        over = {k for k in free if unit * weight[k] > most * sizes[k]}
        if not over:
            return got | {k: unit * weight[k] for k in free}
        for k in over:
            got[k] = most * sizes[k]
            left -= got[k]
        free -= over
    return got


def test_targets_and_takes(spark):
    dice = random.Random(1)
    rows = [(i, " ".join(["w"] * dice.choice([0, 1, 5, 40])), dice.choice(["b", "a", "ü", None, "Z"] + ["a"] * 6)) for i in range(400)]
    out = mixing.tape(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    for r in out:
        assert r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        assert all(0 <= p <= 1 for p in r.positions)
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)


def test_position_inverts_demand(spark):
    from pyspark.sql import functions as F

    for knots in ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (0.0, 1.0, 0.0)):
        cols = [F.lit(float(k)) for k in knots]
        rows = spark.range(0, 101).select((F.col("id") / 100.0).alias("f")).withColumn("t", mixing.training_position(F.col("f"), cols)).collect()
        total = (knots[0] + 2 * knots[1] + knots[2]) / 4
        for f, t in rows:
            x = min(t, 0.5) * 2
            area = (knots[0] * x + (knots[1] - knots[0]) * x * x / 2) / 2
            y = max(t - 0.5, 0) * 2
            area += (knots[1] * y + (knots[2] - knots[1]) * y * y / 2) / 2
            assert area / total == pytest.approx(f, abs=1e-9)


def test_mix_repeats_and_clashing_columns(spark):
    docs = frame(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "s"), (4, "x " * 5000, "t")]).withColumn("target", mixing.F.lit("own"))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) <= {1, 4} and ids.count(4) == 1 and ids.count(1) == 4
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.tape(docs.limit(0)).count() == 0
