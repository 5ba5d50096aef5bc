"""Model boundaries: pluggable encoders and detectors with native defaults, linear heads, clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakewarden.functions.vectors import as_double, dot, unit
from lakewarden.operators import chunks
from lakewarden.operators.contracts import require_none
from lakewarden.operators.language import window_language
from lakewarden.operators.metrics import class_weights
from lakewarden.operators.vectors import centroids


def detect_language(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], Sequence[str | None]]], min_chars: int = 0, batch: int = 1024) -> DataFrame:
    """Adds ``language`` by a detector that ``load`` opens once in each Python worker: ISO codes, ``und`` for short texts and where it says nothing."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = load()
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                out.extend(None if code is None else code.lower() for code in detector(texts[at : at + batch]))
            yield pd.Series(out, dtype="object")

    return df.withColumn("language", window_language(run(F.col(text)), F.char_length(F.coalesce(F.col(text), F.lit(""))), min_chars))


def encode(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], Sequence]], batch: int = 128, normalize: bool = True) -> DataFrame:
    """Adds ``vector``, of unit length if ``normalize``, by a model that ``load`` opens once in each Python worker; texts go to it in batches through Arrow."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                out.extend(list(v) for v in model(texts[at : at + batch]))
            yield pd.Series(out)

    made = df.withColumn("vector", run(F.col(text)))
    return made.withColumn("vector", unit(as_double(F.col("vector"))).cast("array<float>")) if normalize else made


def hashed_vectors(df: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """The native stand-in for an encoder: (key, vector) of signed hash counts of whole texts' tokens, normalised.

    Tokens are exploded and counted by (key, slot), so a text of any length is
    summed by partial aggregates; a text without tokens has a zero vector.
    """
    slot = F.conv(F.substring(F.md5(F.lower("token")), 1, 8), 16, 10).cast("long") % (2 * dimensions)
    words = df.select(key, F.explode_outer(chunks.tokens(F.col(text))).alias("token")).select(key, slot.alias("slot"))
    signed = F.when(F.col("slot") < dimensions, 1).otherwise(-1)
    counts = words.groupBy(key, (F.col("slot") % dimensions).alias("cell")).agg(F.sum(signed).cast("double").alias("x"))
    packed = counts.groupBy(key).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("cell", "x")), lambda c: c["cell"].isNotNull())).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.element_at("m", d.cast("long")), F.lit(0.0)))
    return packed.select(key, unit(cells).alias("vector"))


HEAD = "bias double, weights array<double>"


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def head_scores(df: DataFrame, vector: str, weights: Sequence[float], bias: float) -> DataFrame:
    """Adds ``p`` of a linear head, JVM-side."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return df.withColumn("p", sigmoid(dot(as_double(F.col(vector)), w) + F.lit(float(bias))))


def train_head(df: DataFrame, vector: str, label: str, reg: float = 0.01, iterations: int = 50):
    """Class-balanced logistic regression over frozen vectors."""
    weights = {r.label: r.weight for r in class_weights(df, label).collect()}
    weighted = df.select(array_to_vector(as_double(F.col(vector))).alias("features"), F.col(label).cast("double").alias("label"), F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]).alias("w"))
    return LogisticRegression(weightCol="w", regParam=reg, maxIter=iterations).fit(weighted)


def apply_head(model, df: DataFrame, vector: str) -> DataFrame:
    """Adds ``p`` by the model's weights, natively; a head of other width is refused (a job looks at the widths)."""
    weights = model.coefficients.toArray().tolist()
    require_width(df, vector, len(weights))
    return head_scores(df, vector, weights, model.intercept)


def require_width(df: DataFrame, vector: str, width: int) -> None:
    """Every vector has ``width`` dimensions, else an error: a product with another would silently be null."""
    require_none(df.filter(F.size(vector) != width).select(F.size(vector).alias("width")).distinct(), f"vectors of other width than the head's {width}")


def save_head(model, spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """A head as one row: bias and weights."""
    row = [(float(model.intercept), [float(x) for x in model.coefficients.toArray()])]
    spark.createDataFrame(row, HEAD).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def apply_saved_head(df: DataFrame, vector: str, path: str) -> DataFrame:
    """Adds ``p`` by a saved head, which has to fit the vectors."""
    head = df.sparkSession.read.schema(HEAD).parquet(path).first()
    require_width(df, vector, len(head.weights))
    return head_scores(df, vector, head.weights, head.bias)


def cross_validate(df: DataFrame, vector: str, label: str, fold: str, k: int, test: DataFrame | None = None, **options) -> DataFrame:
    """(fold, part, key columns..., p): k heads, each trained off its fold and applied to the fold (``validation``) and the fixed test set."""
    parts = []
    for i in range(k):
        model = train_head(df.filter(F.col(fold) != i), vector, label, **options)
        parts.append(apply_head(model, df.filter(F.col(fold) == i), vector).withColumns({"run": F.lit(i), "part": F.lit("validation")}))
        if test is not None:
            parts.append(apply_head(model, test, vector).withColumns({"run": F.lit(i), "part": F.lit("test")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def cosine_kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, iterations: int = 25) -> DataFrame:
    """(key, cluster, similarity): spherical k-means; k is clamped to 1..rows; similarity to the unit centre.

    A zero vector has no direction: it trains nothing and is in cluster 0 at
    similarity 0. Rows without a vector are left out.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(key, unit(as_double(F.col(vector))).alias("v"))
    pointing = rows.filter(F.exists("v", lambda x: x != 0))
    lost = rows.filter(~F.exists("v", lambda x: x != 0)).select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity"))
    k = max(1, min(k, pointing.count()))
    features = pointing.select(key, array_to_vector("v").alias("features"))
    if k == 1:
        centre = centroids(pointing.withColumn("one", F.lit(1)), "one", "v").select("centroid")
        placed = pointing.crossJoin(F.broadcast(centre)).select(key, F.lit(0).alias("cluster"), dot(F.col("v"), F.col("centroid")).alias("similarity"))
        return placed.unionByName(lost)
    model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(features)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    placed = model.transform(features).select(key, F.col("prediction").alias("cluster"), vector_to_array("features").alias("v"))
    return placed.select(key, "cluster", dot(F.col("v"), unit(F.get(centres, F.col("cluster")))).alias("similarity")).unionByName(lost)


def check_contract(config: dict, published: dict, reported: Sequence[str] = ("batch_size", "device")) -> list[str]:
    """Fields that must agree raise; drift in the reported ones is returned."""
    wrong = [k for k in published if k not in reported and config.get(k) != published[k]]
    if wrong:
        raise ValueError(f"configuration differs from the published one in {wrong}")
    return [k for k in reported if k in published and config.get(k) != published[k]]


def sweep(configs: dict[str, dict], run: Callable[[str, dict], None]) -> list[str]:
    """Run every configuration in order of name, stopping at the first that fails; returns those that ran."""
    done = []
    for name in sorted(configs):
        run(name, configs[name])
        done.append(name)
    return done


def timed(df: DataFrame, n_nodes: int, clock: Callable[[], float]) -> dict[str, float]:
    """Nodes a second of computing all of ``df`` (no-op sink), 0 where no time passed."""
    began = clock()
    df.write.format("noop").mode("overwrite").save()
    seconds = clock() - began
    return {"n_nodes": n_nodes, "seconds": seconds, "nodes_per_second": n_nodes / seconds if seconds > 0 else 0.0}
