"""Vector scoring: centroids, contrast scores, exact top-k, cluster profiles.

Reference-side tables (centroids, prototypes) are bounded by the number of
classes, never by the corpus; dictionaries are counted and, beyond a bound,
searched in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lakewarden.functions.vectors import as_double, dot, unit
from lakewarden.sources.staging import delete, discard, new_path, stage


def _unit_vector(vector: str) -> Column:
    return array_to_vector(unit(as_double(F.col(vector))))


def centroids(df: DataFrame, key: str | Sequence[str], vector: str) -> DataFrame:
    """Unit mean of unit vectors for each key: (key..., centroid, n).

    One vector aggregate: a task keeps one running sum a key and shuffles that,
    whatever the rows or dimensions. Rows without a vector are left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    found = df.filter(F.col(vector).isNotNull()).select(*keys, _unit_vector(vector).alias("v"))
    means = found.groupBy(*keys).agg(Summarizer.mean(F.col("v")).alias("m"), F.count("*").alias("n"))
    return means.select(*keys, unit(vector_to_array("m")).alias("centroid"), "n")


def contrast_prototypes(df: DataFrame, label: str, vector: str, positive: Sequence, negative: Sequence, sample: DataFrame | None = None) -> DataFrame:
    """One row (malicious, benign) of two class centroids.

    Where no row is benign, the vectors of ``sample``, if given, stand for them:
    rows of the corpus drawn by the caller.
    """
    side = F.when(F.col(label).isin(list(positive)), "malicious").when(F.col(label).isin(list(negative)), "benign")
    rows = df.withColumn("side", side).filter("side is not null").select("side", vector)
    if sample is not None:
        rows = rows.unionByName(sample.select(F.lit("sample").alias("side"), vector))
    classes = centroids(rows, "side", vector)
    return classes.agg(
        F.max(F.when(F.col("side") == "malicious", F.col("centroid"))).alias("malicious"),
        F.coalesce(*[F.max(F.when(F.col("side") == s, F.col("centroid"))) for s in ("benign", "sample")]).alias("benign"),
    )


def contrast_scores(df: DataFrame, vector: str, prototypes: DataFrame) -> DataFrame:
    """Adds sim_malicious, sim_benign and score = their difference.

    ``prototypes`` is the one-row frame of :func:`contrast_prototypes`, so the
    broadcast holds two vectors whatever the corpus.
    """
    scored = df.crossJoin(F.broadcast(prototypes)).withColumn("_v", unit(as_double(F.col(vector))))
    scored = scored.withColumn("sim_malicious", dot(F.col("_v"), F.col("malicious"))).withColumn("sim_benign", dot(F.col("_v"), F.col("benign")))
    return scored.withColumn("score", F.col("sim_malicious") - F.col("sim_benign")).drop("_v", "malicious", "benign")


def nearest_label(score: Column) -> Column:
    """Contrast rule: zero counts as malicious."""
    return F.when(score >= 0, F.lit("malicious")).otherwise(F.lit("benign"))


def fold_prototypes(df: DataFrame, fold: str, label: str, vector: str, positive: Sequence, negative: Sequence, k: int) -> DataFrame:
    """(fold, malicious, benign): for each fold the prototypes of all other folds, from one pass.

    Sums of unit vectors by (fold, side) are added up over the other folds, so
    vectors are read once, not once a fold. A sum needs no division: only its
    direction counts.
    """
    side = F.when(F.col(label).isin(list(positive)), "malicious").when(F.col(label).isin(list(negative)), "benign")
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(fold).alias("own"), side.alias("side"), _unit_vector(vector).alias("v")).filter("side is not null")
    sums = rows.groupBy("own", "side").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("x"))
    # From here on there are folds x sides rows.
    cells = sums.select("own", "side", F.posexplode("x").alias("pos", "x")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("fold != own")
    means = cells.groupBy("fold", "side", "pos").agg(F.sum("x").alias("x"))
    packed = means.groupBy("fold", "side").agg(unit(F.sort_array(F.collect_list(F.struct("pos", "x")))["x"]).alias("c"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("c")))
    return packed.groupBy("fold").agg(pick("malicious").alias("malicious"), pick("benign").alias("benign"))


def max_chunk(scored: DataFrame, key: str, score: str, index: str, carry: Sequence[str] = ()) -> DataFrame:
    """The best window of each owner (the first of equals), with how many it has: an ordinary aggregate of structs."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(index)).alias("i"), *carry)).alias("b")
    out = scored.groupBy(key).agg(best, F.count("*").alias("num_chunks"))
    return out.select(key, F.col("b.s").alias("max_similarity"), (-F.col("b.i")).alias("trigger_chunk_index"), *[F.col(f"b.{c}") for c in carry], "num_chunks")


def mean_pool(windows: DataFrame, key: str, vector: str) -> DataFrame:
    """A document's vector: the unit mean of its windows' unit vectors."""
    return centroids(windows, key, vector).select(key, F.col("centroid").alias("vector"), F.col("n").alias("num_chunks"))


#: References that are on the driver and the executors at once.
BLOCK_ROWS = 4096
#: Up to so many references are scored by expressions, without Python.
NATIVE_ROWS = 64
#: Queries multiplied at a time.
QUERY_ROWS = 512


def top_k(queries: DataFrame, query_key: str, references: DataFrame, reference_key: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_key, rank, reference_key, similarity): the k references of highest inner product of unit vectors, smaller key first on ties. Exact.

    References are counted (a job). A few are packed into one broadcast row and
    scored by expressions. More are multiplied as matrices of at most
    ``block_rows`` rows through Arrow, which is some fifty times cheaper an
    element. Where they fill more than one block, references are staged by block
    and queries once; one block at a time is gathered, broadcast, searched,
    staged and dropped, so the driver and the executors never hold more of a
    dictionary than that; each block keeps its own k best of every query and the
    best of those win. Rows without a vector are left out.
    """
    refs = references.filter(F.col(vector).isNotNull()).select(F.col(reference_key).alias("rk"), unit(as_double(F.col(vector))).alias("rv"))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key), unit(as_double(F.col(vector))).alias("qv"))
    n = refs.count()
    if n <= min(NATIVE_ROWS, block_rows):
        packed = refs.agg(F.collect_list(F.struct("rk", "rv")).alias("refs"))
        scored = F.transform("refs", lambda r: F.struct((-dot(F.col("qv"), r["rv"])).alias("neg"), r["rk"].alias("rk")))
        best = asked.crossJoin(F.broadcast(packed)).select(query_key, F.slice(F.sort_array(scored), 1, k).alias("best"))
        rows = best.select(query_key, F.posexplode("best").alias("p", "b"))
        return rows.select(query_key, (F.col("p") + 1).cast("long").alias("rank"), F.col("b.rk").alias(reference_key), (-F.col("b.neg")).alias("similarity"))
    if n <= block_rows:
        return _block_best(asked, query_key, refs, k)[0].withColumnRenamed("rk", reference_key)
    return _best_of_blocks(asked, query_key, refs, k, -(-n // block_rows)).withColumnRenamed("rk", reference_key)


def _best_of_blocks(asked: DataFrame, query_key: str, refs: DataFrame, k: int, blocks: int) -> DataFrame:
    """The k best of all references for every query, one block of references after another; only the result stays staged."""
    spark = asked.sparkSession
    dealt = new_path(spark, "references")
    refs = refs.withColumn("block", F.pmod(F.xxhash64("rk", "rv"), F.lit(blocks)).cast("int"))
    refs.repartition("block").write.partitionBy("block").parquet(dealt)
    stored = spark.read.schema(refs.schema).parquet(dealt)
    asked, found = stage(asked, "queries"), []
    for block in range(blocks):
        best, shared = _block_best(asked, query_key, stored.filter(F.col("block") == block).drop("block"), k)
        found.append(stage(best, "block-best"))
        shared.destroy()
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    order = Window.partitionBy(query_key).orderBy(F.col("similarity").desc(), "rk")
    result = stage(every.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k), "top-k")
    for table in [asked, *found]:
        discard(table)
    delete(spark, dealt)
    return result


def _block_best(asked: DataFrame, query_key: str, refs: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """The k best of one block for every query, and the block, which is bounded by its caller, gathered and broadcast."""
    rows = sorted(refs.collect(), key=lambda r: r.rk)
    shared = asked.sparkSession.sparkContext.broadcast(([r.rk for r in rows], np.array([r.rv for r in rows], np.float64)))
    key_kind = to_arrow_type(refs.schema["rk"].dataType)
    kinds = {query_key: asked.schema[query_key].dataType.simpleString(), "rank": "bigint", "rk": refs.schema["rk"].dataType.simpleString(), "similarity": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = shared.value
        names = pa.array(keys, key_kind)
        for whole in batches:
            for at in range(0, whole.num_rows if len(keys) else 0, QUERY_ROWS):
                batch = whole.slice(at, QUERY_ROWS)
                asked_for = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                # Rounded so that equal vectors tie, however the product was summed.
                scores = np.round(asked_for @ matrix.T, 12)
                most = min(k, len(keys))
                least = np.partition(scores, len(keys) - most, axis=1)[:, len(keys) - most]
                query, ref = np.nonzero(scores >= least[:, None])
                order = np.lexsort((ref, -scores[query, ref], query))
                query, ref = query[order], ref[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
                query, ref, rank = query[rank <= most], ref[rank <= most], rank[rank <= most]
                columns = [batch.column(0).take(pa.array(query)), pa.array(rank, pa.int64()), names.take(pa.array(ref)), pa.array(scores[query, ref])]
                yield pa.record_batch(columns, names=list(kinds))

    return asked.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items())), shared


def cluster_profile(members: DataFrame, cluster: str, category: str, text: str, similarity: str, key: str, n_clusters: int) -> DataFrame:
    """One row a cluster 0..n-1: size, most frequent category (the smaller name on ties), text of the most similar member; blanks if empty."""
    every = members.sparkSession.range(n_clusters).select(F.col("id").alias(cluster))
    counted = members.groupBy(cluster, category).agg(F.count("*").alias("n"), F.max(F.struct(F.col(similarity).alias("s"), (-F.col(key)).alias("k"), F.col(text).alias("t"))).alias("best"))
    top = counted.groupBy(cluster).agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), F.col(category).alias("c"))).alias("mode"), F.max("best").alias("best"))
    filled = every.join(top, cluster, "left")
    return filled.select(cluster, F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.col("mode.c").cast("string"), F.lit("")).alias("category"), F.coalesce(F.col("best.t").cast("string"), F.lit("")).alias("rep_text"))


def threshold_flags(score: Column, thresholds: Sequence[float]) -> Column:
    """Map from threshold to whether the score reaches it."""
    return F.map_from_arrays(F.array(*[F.lit(str(t)) for t in thresholds]), F.array(*[score >= t for t in thresholds]))
