"""Ranking and confusion metrics, grouped by any columns, without collecting scores.

Everything that ranks first collapses to one row for each distinct score, so the
windows see distinct scores and not rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lakewarden.operators.contracts import require_none


def ratio(top: Column, bottom: Column, empty: Column | None = None) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0) if empty is None else empty)


def confusion(df: DataFrame, label: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """n, n_pos, tp, fp, fn, tn, n_flagged, precision, recall, accuracy, f1, flag_rate; empty denominators give 0, rates of no rows NaN."""
    y, p = F.col(label) == 1, F.col(flag)
    counted = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y).alias("n_pos"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    nan = F.lit(float("nan"))
    rated = counted.withColumns({"n_flagged": F.col("tp") + F.col("fp"), "precision": precision, "recall": recall, "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n"), nan), "flag_rate": ratio(F.col("tp") + F.col("fp"), F.col("n"), nan)})
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def argmax_flag(p: Column) -> Column:
    """Unsafe only if its probability is strictly larger."""
    return p > 1 - p


def threshold_at_recall(df: DataFrame, score: str, label: str, recall: float, by: Sequence[str] = ()) -> DataFrame:
    """The score of the ceil(n * recall)-th best positive in each group: the highest threshold that reaches the recall.

    Positives are counted by distinct score first, then by slices of scores: the
    slice in which the running count reaches the place is known from few rows,
    and only the scores of that slice are ranked. No positive in a group gives
    no row.
    """
    if not 0 < recall <= 1:
        raise ValueError("recall must be in (0, 1]")
    counted = df.filter(F.col(label) == 1).groupBy(*by, F.col(score).alias("_x")).agg(F.count("*").alias("_p"), F.count("*").alias("_n"))
    rows, slices = _sliced(counted, by)
    place = F.ceil(F.col("all_pos") * F.lit(float(recall)))
    met = slices.withColumn("_place", place).filter((F.col("tp0") < F.col("_place")) & (F.col("_place") <= F.col("tp0") + F.col("sp")))
    upto = Window.partitionBy("_k").orderBy(F.col("_x").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = rows.join(met, ["_k", "_s"]).withColumn("_reached", F.col("tp0") + F.sum("_p").over(upto))
    return reached.filter("_reached >= _place").groupBy(*by).agg(F.max("_x").alias("threshold"))


#: Slices of the range of scores.
SLICES = 1024


def _sliced(points: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Points (by..., a score _x, its positives _p and rows _n) with group ``_k`` and slice ``_s``, higher for higher scores, and the slices with what stands above them.

    Slices cut the arc tangent of the score evenly, finest where scores between
    -1 and 1 stand, so no pass looks for bounds and a group of any number of
    distinct scores is ranked in many tasks; slices: _k, _s, sp, tp0, cn0,
    all_pos, all_rows, at most SLICES + 2 rows a group.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    x = F.col("_x")
    at = F.when(x.isNull(), -1).when(F.isnan(x), SLICES + 1).otherwise(F.floor((F.atan(x * 4) / math.pi + 0.5) * SLICES))
    rows = points.withColumns({"_k": group, "_s": at.cast("int")})
    sums = rows.groupBy("_k", "_s").agg(F.sum("_p").alias("sp"), F.sum("_n").alias("sn"))
    whole = Window.partitionBy("_k")
    above = whole.orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    return rows, sums.select("_k", "_s", "sp", before("sp").alias("tp0"), before("sn").alias("cn0"), F.sum("sp").over(whole).alias("all_pos"), F.sum("sn").over(whole).alias("all_rows"))


def ties(df: DataFrame, score: str, label: str, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives whose score equals the threshold."""
    return df.groupBy(*by).agg(F.count_if(F.col(score) == threshold).alias("n_ties"), F.count_if((F.col(score) == threshold) & (F.col(label) == 1)).alias("n_pos_ties"))


def ranking(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """average_precision (step form), roc_auc (ties count half) and pr_auc (trapezoids ending at recall 0, precision 1); NaN with one class only."""
    points = df.groupBy(*by, F.col(score).alias("_x")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count("*").alias("_n"))
    rows, slices = _sliced(points, by)
    upto = Window.partitionBy("_k", "_s").orderBy(F.col("_x").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = rows.join(slices, ["_k", "_s"]).withColumns({"tp": F.col("tp0") + F.sum("_p").over(upto), "cn": F.col("cn0") + F.sum("_n").over(upto)})
    # The point before a point has all but the point's own rows.
    tp, cn, share = F.col("tp") - F.col("_p"), F.col("cn") - F.col("_n"), lambda c: F.when(F.col("all_pos") > 0, c / F.col("all_pos"))
    curve = curve.withColumns({"_prec": F.col("tp") / F.col("cn"), "_rec": share(F.col("tp")), "_prec0": F.when(cn > 0, F.try_divide(tp, cn)).otherwise(1.0), "_rec0": F.coalesce(share(tp), F.lit(0.0))})
    pos, neg = F.col("all_pos"), F.col("all_rows") - F.col("all_pos")
    out = curve.groupBy(*by, "all_pos", "all_rows").agg(
        F.sum(F.col("_p") * F.col("tp") / F.col("cn")).alias("_ap"), F.sum((F.col("_n") - F.col("_p")) * (F.col("tp") - F.col("_p") / 2)).alias("_auc"), F.sum((F.col("_rec") - F.col("_rec0")) * (F.col("_prec") + F.col("_prec0")) / 2).alias("_pr"),
    )
    nan, both = F.lit(float("nan")), (pos > 0) & (neg > 0)
    return out.select(
        *by, F.when(both, F.try_divide(F.col("_ap"), pos)).otherwise(nan).alias("average_precision"), F.when(both, F.try_divide(F.col("_auc"), pos * neg)).otherwise(nan).alias("roc_auc"), F.when(both, F.col("_pr")).otherwise(nan).alias("pr_auc"),
    )


def held_out(validation: DataFrame, test: DataFrame, score: str, label: str, recall: float, by: str = "fold") -> DataFrame:
    """One row a fold: the threshold that its validation rows give, and what it does there and on the fixed test set.

    validation and test have (by, score, label); the test set is scored anew for
    every fold. Columns: threshold, counts of ties, validation_recall,
    validation_positive_count, recall_ok (within one positive of ``recall``), and
    the confusion and ranking metrics of the test rows.
    """
    limits = threshold_at_recall(validation, score, label, recall, [by])
    marked = [df.join(F.broadcast(limits), by).withColumn("_flag", F.col(score) >= F.col("threshold")) for df in (validation, test)]
    tied = [ties(df, score, label, F.col("threshold"), [by]) for df in marked]
    own = confusion(marked[0], label, "_flag", [by])
    ok = F.abs(F.col("recall") - recall) <= 1 / F.col("n_pos") + 1e-12
    own = own.select(by, F.col("recall").alias("validation_recall"), F.col("n_pos").alias("validation_positive_count"), ok.alias("recall_ok"))
    out = limits.join(own, by).join(confusion(marked[1], label, "_flag", [by]), by).join(ranking(test, score, label, [by]), by)
    for name, found in zip(("validation", "test"), tied):
        out = out.join(found.select(by, F.col("n_ties").alias(f"{name}_ties"), F.col("n_pos_ties").alias(f"{name}_positive_ties")), by)
    return out


def require_recall(evaluated: DataFrame, by: str = "fold") -> DataFrame:
    """The folds of ``held_out``, or an error that names those whose validation recall misses the target by more than one positive. Starts a job."""
    require_none(evaluated.filter(~F.col("recall_ok")).select(by, "validation_recall"), "folds whose recall misses the target")
    return evaluated


def checkpoint_table(scored: DataFrame, p: str, label: str, epoch: str = "epoch") -> DataFrame:
    """One row a checkpoint: argmax confusion metrics and ranking of its scored rows, best f1 first."""
    flagged = scored.withColumn("_flag", argmax_flag(F.col(p)))
    return confusion(flagged, label, "_flag", [epoch]).join(ranking(scored, p, label, [epoch]), epoch).orderBy(F.col("f1").desc(), epoch)


def fold_summary(folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The folds, then rows ``mean`` and ``std`` (of a sample) of the named columns."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    rows = folds.select(F.col("fold").cast("string").alias("fold"), *doubles)
    mean = rows.agg(*[F.avg(c).alias(c) for c in columns]).select(F.lit("mean").alias("fold"), *columns)
    std = rows.agg(*[F.stddev_samp(c).alias(c) for c in columns]).select(F.lit("std").alias("fold"), *columns)
    return rows.unionByName(mean).unionByName(std)


def throughput(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation of n_nodes / seconds (0 for no time); n_nodes must agree over folds, else both are null."""
    rate = F.when(F.col("seconds") > 0, F.col("n_nodes") / F.col("seconds")).otherwise(0.0)
    out = folds.agg(F.avg(rate).alias("mean"), F.stddev_samp(rate).alias("std"), F.min("n_nodes").alias("lo"), F.max("n_nodes").alias("hi"))
    same = F.col("lo") == F.col("hi")
    return out.select(F.when(same, F.col("mean")).alias("nodes_per_second_mean"), F.when(same, F.col("std")).alias("nodes_per_second_std"))


def class_weights(df: DataFrame, label: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Balanced weights n / (classes * count), counts floored at 1."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(f"c{c}") for c in classes])
    rows = F.array(*[F.struct(F.lit(c).cast("long").alias("label"), F.col(f"c{c}").alias("n"), (F.col("n") / (len(classes) * F.greatest(F.col(f"c{c}"), F.lit(1)))).alias("weight")) for c in classes])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
