"""Samples, folds and metrics: properties and brute force."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lakewarden.operators import metrics, sampling


def test_split_rounds_half_even(spark):
    rows = [(f"{s}{i}", s) for s, n in (("a", 15), ("b", 35), ("c", 1)) for i in range(n)]
    out = sampling.split(spark.createDataFrame(rows, "id string, s string"), "id", "s", 0.3)
    assert {r.s: r.n for r in out.filter("split = 'test'").groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 4, "b": 10}
    assert out.count() == 51


def test_folds_partition(spark):
    rows = [(i, "5" if i % 4 == 0 else "0") for i in range(43)]
    df = spark.createDataFrame(rows, "id int, severity string")
    out = sampling.folds(df, "id", "severity", 5)
    assert out.count() == 43 and {r.fold for r in out.collect()} == set(range(5))
    sizes = [r["count"] for r in out.groupBy("severity", "fold").count().collect() if r.severity == "0"]
    assert max(sizes) - min(sizes) <= 1
    assert all(r.ok for r in sampling.fold_coverage(out, 5, "5").collect())
    small = sampling.folds(spark.createDataFrame([(1, "5"), (2, "5"), (3, "0")], "id int, severity string"), "id", "severity", 3)
    assert not all(r.ok for r in sampling.fold_coverage(small, 3, "5").collect())
    renamed = out.withColumnRenamed("id", "node_id")
    assert sampling.same_assignment(renamed, renamed.orderBy("node_id"))
    assert sampling.reconcile(renamed, renamed) is renamed
    with pytest.raises(ValueError):
        sampling.reconcile(renamed, renamed.withColumn("fold", F.col("fold") + 1))


def test_samples(spark):
    df = spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(50)], "id int, s string")
    a, b = sampling.simple(df, "id", 10).collect(), sampling.simple(df.repartition(7), "id", 10).collect()
    assert sorted(a) == sorted(b) and len(a) == 10 and sampling.simple(df, "id", 99).count() == 50
    assert {r.s: r["count"] for r in sampling.stratified(df, "id", "s", 5).groupBy("s").count().collect()} == {"x": 3, "y": 5}


def brute(points):
    """points: (score, y)."""
    pos, neg = [s for s, y in points if y], [s for s, y in points if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, pr, last = 0.0, 0.0, (0.0, 1.0)
    for t in sorted({s for s, _ in points}, reverse=True):
        tp, n = sum(y for s, y in points if s >= t), sum(s >= t for s, _ in points)
        rec, prec = tp / len(pos), tp / n
        ap += (rec - last[0]) * prec
        pr += (rec - last[0]) * (prec + last[1]) / 2
        last = (rec, prec)
    return ap, auc, pr


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9]), st.integers(0, 1)), min_size=2, max_size=30))
def test_ranking(spark, points):
    df = spark.createDataFrame([(float(s), y) for s, y in points], "score double, y int")
    got = metrics.ranking(df, "score", "y").first()
    if len({y for _, y in points}) < 2:
        assert all(math.isnan(x) for x in got)
    else:
        assert (got.average_precision, got.roc_auc, got.pr_auc) == pytest.approx(brute(points))


@pytest.mark.parametrize("n, recall", [(1, 0.8), (5, 0.8), (10, 0.8), (7, 1.0), (40, 0.05)])
def test_threshold(spark, n, recall):
    dice = random.Random(n)
    scores = [round(dice.random(), 1) for _ in range(n)]
    df = spark.createDataFrame([(s, 1) for s in scores] + [(0.95, 0)], "score double, y int")
    got = metrics.threshold_at_recall(df, "score", "y", recall).first().threshold
    assert got == sorted(scores, reverse=True)[math.ceil(n * recall) - 1]
    assert sum(s >= got for s in scores) / n >= recall
    assert metrics.threshold_at_recall(df.filter("y = 0"), "score", "y", recall, ["y"]).count() == 0
    with pytest.raises(ValueError):
        metrics.threshold_at_recall(df, "score", "y", 0.0)


def test_confusion(spark):
    df = spark.createDataFrame([(1, True), (1, False), (0, True), (0, False), (0, False)], "y int, flag boolean")
    r = metrics.confusion(df, "y", "flag").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.accuracy, r.f1, r.flag_rate) == (1, 1, 1, 2, 0.5, 0.5, 0.6, 0.5, 0.4)
    none = metrics.confusion(df.filter("not flag"), "y", "flag").first()
    assert none.precision == 0 and none.recall == 0 and none.f1 == 0
    empty = metrics.confusion(df.limit(0), "y", "flag").first()
    assert math.isnan(empty.flag_rate) and math.isnan(empty.accuracy)
    assert spark.range(1).select(metrics.argmax_flag(F.lit(0.5)).alias("x")).first().x is False


def test_summaries(spark):
    folds = spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, x double")
    out = {r.fold: r.x for r in metrics.fold_summary(folds, ["x"]).collect()}
    assert out == {"0": 1.0, "1": 3.0, "mean": 2.0, "std": pytest.approx(2**0.5)}
    ran = spark.createDataFrame([(0, 10, 2.0), (1, 10, 0.0)], "fold int, n_nodes int, seconds double")
    assert metrics.throughput(ran).first().nodes_per_second_mean == 2.5
    assert metrics.throughput(ran.withColumn("n_nodes", F.col("fold"))).first().nodes_per_second_mean is None
    weights = {r.label: r.weight for r in metrics.class_weights(spark.createDataFrame([(0,)] * 3 + [(1,)], "y int"), "y").collect()}
    assert weights == {0: 4 / 6, 1: 2.0}


def test_no_window_holds_a_stratum_or_a_fold(spark):
    """Ranks within strata and folds come from slices: what a window is dealt by is more than the group alone."""
    import re

    rows = spark.range(1000).selectExpr("id", "'all' as severity", "cast(id % 7 as double) / 3 as score", "id % 2 as y", "cast(id % 3 as string) as fold")
    for df in (sampling.split(rows, "id", "severity", 0.3), sampling.folds(rows, "id", "severity", 5), metrics.ranking(rows, "score", "y", ["fold"])):
        text = df._jdf.queryExecution().executedPlan().toString()
        ranked = [w for w in re.findall(r"Window \[(.*?)\], \[(.*?)\], \[(.*?)\]", text) if "row_number" in w[0] or "_p#" in w[0]]
        assert ranked and all("_s#" in by for _, by, _ in ranked)


def test_slices_do_not_matter(spark, monkeypatch):
    """Few or many slices, scores far outside [-1, 1], nulls and NaN: the same ranks."""
    dice = random.Random(5)
    odd = [None, float("nan"), float("inf"), -1e300, 1e9, 0.0]
    rows = spark.createDataFrame([(k, dice.choice(odd) if k % 11 == 0 else dice.uniform(-3, 3), k % 2, "a" if k % 3 else None) for k in range(300)], "id long, score double, y long, fold string")
    found = []
    for n in (1, 7, 1024):
        monkeypatch.setattr(metrics, "SLICES", n)
        found.append([sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect()) for df in (metrics.ranking(rows, "score", "y", ["fold"]), metrics.threshold_at_recall(rows, "score", "y", 0.7, ["fold"]), metrics.ranking(rows, "score", "y"))])
    assert found[0] == found[1] == found[2]
