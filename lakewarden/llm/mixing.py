"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a weight schedule over training progress, piecewise linear
between knots. Its words demanded up to progress ``t`` are its target times the
normalised integral of the schedule; inverting that cumulative demand turns a
place on the source's own word tape into a training position in [0, 1], and
documents are range-sorted by position. A source whose target exceeds its size
reads its tape again, up to ``max_repeats`` times.

Where a document stands on its source's tape is a prefix sum. One source may
hold a third of all rows, so the sum has two levels: the tape is cut into
``buckets`` slices by the MD5 of the id, slices are summed by an ordinary
aggregate, and a running window works inside one slice only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lakewarden.llm.scratch import stage
from lakewarden.llm.text_rules import SPACE_WORD
from lakewarden.sources.tables import table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix against words of all sources.
SHARE = 1.5
#: No source gives more than this many times its own size.
MAX_REPEATS = 2
#: Relative weight at progress 0, 1/2 and 1, repeating like the weights: the first source fades, the second rises, the third peaks midway.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (0.75, 1.25, 0.75))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and joins null to null."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources: (key, source_size) to (key, source_size, rank, target).

    Proportional to weight, stopped at ``max_repeats * source_size``, the excess
    shared again by weight. That fixed point is one water level: with sources in
    order of cap over weight, the level is the first one that does not pass the
    next cap. One row a source, so its windows are small whatever the corpus.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    table_ = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(table_, F.col("rank") % len(weights))).withColumn("cap", F.col("source_size") * float(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    levels = levels.withColumn("place", F.row_number().over(order))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.coalesce(F.min_by("level", F.when(fits, F.col("place"))).over(whole), F.max("level").over(whole))
    return levels.select("key", "source_size", "rank", F.least(level * F.col("weight"), F.col("cap")).alias("target"))


def training_position(fraction: Column, knots: Sequence[Column]) -> Column:
    """Progress t at which ``fraction`` of a source's demand has been met.

    ``knots`` are its relative weights at progress 0, 1/2, 1. The integral over
    one half starting at weight a and ending at b, after x of the half, is
    ``(a x + (b - a) x^2 / 2) / 2``; its inverse is written without division by
    ``b - a`` so that flat pieces work.
    """
    a, b, c = knots
    first, second = (a + b) * 0.25, (b + c) * 0.25
    need = fraction * (first + second)

    def inverse(start: Column, end: Column, area: Column) -> Column:
        double = area * 2.0
        return F.coalesce(F.try_divide(double * 2.0, start + F.sqrt(F.greatest(start * start + (end - start) * double * 2.0, F.lit(0.0)))), F.lit(0.0))

    return F.when(need <= first, inverse(a, b, need) * 0.5).otherwise(F.least(inverse(b, c, need - first) * 0.5 + 0.5, F.lit(1.0)))


def tape(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, schedules: Sequence[Sequence[float]] = SCHEDULES, extra: Sequence[str] = ()) -> DataFrame:
    """Per document: id, size, source_size, target, takes (copies in the mix), taken, position (of its first copy, null if none), fractions.

    Copy k of a document is taken if the middle of its words, k tape lengths on,
    is before the target, so a source's taken words miss its target by at most
    half a document. A null text has size 0, a null source is a source of its
    own, rows that repeat are separate rows; an empty table gives an empty
    result; columns beside the named ones are ignored but for ``extra``.
    """
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), source_key(F.col(source_col)).alias("key"), order.alias("h"), F.substring(order, 1, 3).alias("slice"), *extra)
    narrow = stage(rows.drop(*extra), "mix")
    rows = rows if extra else narrow
    slices = narrow.groupBy("key", "slice").agg(F.sum("size").alias("slice_size"))
    along = Window.partitionBy("key").orderBy("slice")
    slices = slices.withColumn("start", F.coalesce(F.sum("slice_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = water_fill(slices.groupBy("key").agg(F.sum("slice_size").alias("source_size")), weights, share, max_repeats)
    placed = slices.join(targets, "key").select("key", "slice", "start", "source_size", "target", "rank")
    within = Window.partitionBy("key", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(placed, ["key", "slice"]).withColumn("end", F.col("start") + F.sum("size").over(within))
    middle = F.col("end") * 2 - F.col("size")
    shape = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules]), F.col("rank") % len(schedules))
    rows = rows.withColumn("middle", middle).withColumn("shape", shape)
    copies = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: F.col("middle") + k * 2 * F.col("source_size") < F.col("target") * 2.0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.array().cast("array<int>")))
    knots = [F.get("shape", F.lit(i)) for i in range(3)]
    at = F.transform("copies", lambda k: training_position((F.col("middle") + k * 2 * F.col("source_size")) / (F.col("target") * 2.0), knots))
    rows = rows.withColumn("positions", at)
    return rows.select("doc_id", "size", "source_size", "target", F.size("copies").alias("takes"), (F.size("copies") * F.col("size")).alias("taken"), F.get("positions", F.lit(0)).alias("position"), "positions", *extra)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` in training order, a row for each copy, columns unchanged.

    Documents without words have nothing to train on and are not taken. Rows
    are dealt out by their own number so that repeated ids stay apart.
    """
    own = docs.columns
    extra = [c for c in own if c not in ("doc_id", "text", "source")]
    rows = F.struct(*[F.col(c) for c in own])
    placed = tape(docs.select("doc_id", "text", "source", rows.alias("_row")), extra=["_row"])
    taken = placed.select("_row", F.explode("positions").alias("_position"))
    return taken.repartitionByRange(F.col("_position")).sortWithinPartitions("_position").select("_row.*")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed at 150 % of their words, one row a document, range-sorted by training position."""
    placed = tape(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('0' || source, '1') AS key, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
r AS (SELECT *, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS rank FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + rank % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
        row_number() OVER (ORDER BY cap / weight, rank) AS place FROM w),
t AS (SELECT key, source_size, rank, least(coalesce((SELECT arg_min(level, place) FROM l WHERE level * weight <= cap), (SELECT max(level) FROM l)) * weight, cap) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY d.key ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT * 2 - d.size AS middle
      FROM d JOIN t ON d.key = t.key),
k AS (SELECT *, CASE WHEN size > 0 AND middle < target * 2.0::DOUBLE THEN 1 ELSE 0 END + CASE WHEN size > 0 AND middle + 2 * source_size < target * 2.0::DOUBLE THEN 1 ELSE 0 END AS takes,
      [[1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE], [0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE], [0.75::DOUBLE, 1.25::DOUBLE, 0.75::DOUBLE]][1 + rank % 3] AS z FROM p),
n AS (SELECT *, (z[1] + z[2]) * 0.25::DOUBLE AS f, (z[2] + z[3]) * 0.25::DOUBLE AS g, middle / (target * 2.0::DOUBLE) * ((z[1] + z[2]) * 0.25::DOUBLE + (z[2] + z[3]) * 0.25::DOUBLE) AS need FROM k)
SELECT doc_id, size, source_size, target, (takes * size)::BIGINT AS taken,
  CASE WHEN takes = 0 THEN NULL
       WHEN need <= f THEN (need * 2.0::DOUBLE) * 2.0::DOUBLE / (z[1] + sqrt(greatest(z[1] * z[1] + (z[2] - z[1]) * (need * 2.0::DOUBLE) * 2.0::DOUBLE, 0))) * 0.5::DOUBLE
       ELSE least(((need - f) * 2.0::DOUBLE) * 2.0::DOUBLE / (z[2] + sqrt(greatest(z[2] * z[2] + (z[3] - z[2]) * ((need - f) * 2.0::DOUBLE) * 2.0::DOUBLE, 0))) * 0.5::DOUBLE + 0.5::DOUBLE, 1.0::DOUBLE) END AS position
FROM n
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": ORACLE}
