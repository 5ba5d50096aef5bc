"""Queries over ``embeddings`` (labels 3, 4, 5 are malicious, 0 is benign), metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.functions.vectors import as_double, dot, unit
from lakewarden.operators import metrics, models, nodes, report, sampling, scan, vectors as V
from lakewarden.plans.text_plans import RAW_SQL, WS, raw_conversations
from lakewarden.sources.staging import stage
from lakewarden.sources.tables import table

MALICIOUS, BENIGN = (3, 4, 5), (0,)
FOLDS, RECALL = 5, 0.8
THRESHOLDS = (-0.1, 0.0, 0.05, 0.1, 0.2)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    vecs = embeddings(spark, folder)
    protos = V.contrast_prototypes(vecs, "label", "embedding", MALICIOUS, BENIGN)
    return V.contrast_scores(vecs, "embedding", protos)


def contrast_flag_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many vectors of each label the zero-contrast rule flags."""
    return _scored(spark, folder).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0).alias("n_flagged"))


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = V.centroids(embeddings(spark, folder), "label", "embedding")
    return found.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def contrast_scores(spark: SparkSession, folder: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("sim_malicious", "sim_benign", "score")}
    return _scored(spark, folder).withColumns(rounded).select("vec_id", *rounded, V.nearest_label(F.col("score")).alias("nearest"))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    """Five vectors make a document."""
    return embeddings(spark, folder).withColumns({"owner": F.floor(F.col("vec_id") / 5).cast("long"), "chunk_index": F.col("vec_id") % 5})


def contrast_max_chunk(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder).withColumns({"owner": F.floor(F.col("vec_id") / 5).cast("long"), "chunk_index": F.col("vec_id") % 5})
    best = V.max_chunk(scored, "owner", "score", "chunk_index", ["sim_malicious"])
    return best.withColumns({"max_similarity": F.round("max_similarity", 6), "sim_malicious": F.round("sim_malicious", 6)})


def doc_vector_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    pooled = V.mean_pool(_windows(spark, folder), "owner", "embedding")
    return pooled.select("owner", "num_chunks", F.round(F.get("vector", F.lit(0)), 6).alias("x0"), F.round(F.get("vector", F.lit(63)), 6).alias("x63"))


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    vecs = embeddings(spark, folder)
    refs = vecs.filter(F.col("label").isin(*MALICIOUS)).select(F.col("vec_id").alias("ref_id"), "embedding")
    found = V.top_k(vecs.select("vec_id", "embedding"), "vec_id", refs, "ref_id", "embedding", 5)
    return found.withColumn("similarity", F.round("similarity", 6))


def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    vecs = embeddings(spark, folder)
    centres = V.centroids(vecs, "label", "embedding").select(F.col("label").alias("cluster"), "centroid")
    members = vecs.join(centres, F.col("label") == F.col("cluster")).select("vec_id", F.col("cluster").cast("long").alias("cluster"), (F.col("vec_id") % 3).cast("string").alias("category"), F.concat(F.lit("v"), "vec_id").alias("t"), F.round(dot(unit(as_double(F.col("embedding"))), F.col("centroid")), 6).alias("s"))
    return V.cluster_profile(members, "cluster", "category", "t", "s", "vec_id", 12)


def threshold_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("vec_id", F.to_json(V.threshold_flags(F.col("score"), [0.0, 0.1])).alias("threshold_flags"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the labels in play, with a fold by hash."""
    rows = embeddings(spark, folder).filter(F.col("label").isin(*MALICIOUS, *BENIGN)).withColumn("y", (F.col("label") != 0).cast("long"))
    return sampling.folds(rows, "vec_id", "label", FOLDS)


def _fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector scored against the prototypes of the folds it is not in. Vectors are folded once, for prototypes and scores."""
    rows = stage(_labelled(spark, folder).select("vec_id", "label", "embedding", "y", "fold"), "folded")
    protos = V.fold_prototypes(rows, "fold", "label", "embedding", MALICIOUS, BENIGN, FOLDS)
    scored = rows.join(F.broadcast(protos), "fold").withColumn("v", unit(as_double(F.col("embedding"))))
    return scored.select("vec_id", "label", "fold", "y", F.round(dot(F.col("v"), F.col("malicious")) - dot(F.col("v"), F.col("benign")), 4).alias("score"))


def _staged_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores that several parts of a metric read: computed once."""
    return stage(_fold_scores(spark, folder).select("fold", "y", "score"), "fold-scores")


def fold_contrast(spark: SparkSession, folder: str) -> DataFrame:
    return _fold_scores(spark, folder)


def threshold_at_recall(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.threshold_at_recall(_staged_scores(spark, folder), "score", "y", RECALL, ["fold"])


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    scored = _staged_scores(spark, folder)
    return scored.join(F.broadcast(metrics.threshold_at_recall(scored, "score", "y", RECALL, ["fold"])), "fold").withColumn("flag", F.col("score") >= F.col("threshold"))


def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.confusion(_flagged(spark, folder), "y", "flag", ["fold"])
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "flag_rate", "f1")})


def tie_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ties(_flagged(spark, folder), "score", "y", F.col("threshold"), ["fold"])


def _ranking(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return metrics.ranking(_staged_scores(spark, folder), "score", "y", ["fold"]).select("fold", F.round(name, 6).alias(name))


def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder, "average_precision")


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder, "roc_auc")


def pr_auc_trapezoid(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder, "pr_auc")


def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    names = ["n", "tp", "fp", "precision", "recall"]
    found = metrics.fold_summary(metrics.confusion(_flagged(spark, folder), "y", "flag", ["fold"]), names)
    return found.select("fold", *[F.round(c, 6).alias(c) for c in names])


def throughput_summary(spark: SparkSession, folder: str) -> DataFrame:
    folds = spark.range(FOLDS).select(F.col("id").alias("fold"), F.lit(8680).alias("n_nodes"), (F.col("id") * 0.5 + 20.0).alias("seconds"))
    return metrics.throughput(folds).select(*[F.round(c, 6).alias(c) for c in ("nodes_per_second_mean", "nodes_per_second_std")])


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.class_weights(_labelled(spark, folder), "y").withColumn("weight", F.round("weight", 6))


def sigmoid_head_score(spark: SparkSession, folder: str) -> DataFrame:
    weights = [((k % 7) - 3) / 4 for k in range(64)]
    scored = models.head_scores(embeddings(spark, folder), "embedding", weights, 0.25)
    return scored.select("vec_id", F.round("p", 6).alias("p"), metrics.argmax_flag(F.col("p")).alias("unsafe"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation nodes with a stand-in score."""
    posts, comments = raw_conversations(spark, folder)
    both = nodes.posts(posts).unionByName(nodes.comments(comments))
    number = F.conv(F.substring(F.md5("node_id"), 1, 4), 16, 10).cast("long")
    return both.withColumns({"max_similarity": F.round(number / 65536 * 1.3 - 0.2, 4), "nearest_category": F.when(number % 2 == 0, "a").otherwise("b"), "nearest_threat_id": F.concat(F.lit("seed:"), (number % 40).cast("string"))})


RESULTS_SQL = RAW_SQL + """, q AS (SELECT *, ('0x' || substr(md5(node_id), 1, 4))::BIGINT AS h FROM nodes),
r AS (SELECT *, round(h / 65536 * 1.3::DOUBLE - 0.2::DOUBLE, 4) AS max_similarity, CASE WHEN h % 2 = 0 THEN 'a' ELSE 'b' END AS nearest_category, 'seed:' || h % 40 AS nearest_threat_id FROM q)
"""


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return report.threshold_sweep(_results(spark, folder), [0.0, 0.4, 0.55, 0.9, 2.0])


def strata_sample(spark: SparkSession, folder: str) -> DataFrame:
    return report.strata_sample(_results(spark, folder), 10).select("node_id", "max_similarity", "stratum")


def strata_unassigned(spark: SparkSession, folder: str) -> DataFrame:
    return report.unassigned(_results(spark, folder))


def top_matches(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder)
    items = table(spark, folder, "benchmark").select(F.concat(F.lit("seed:"), "item_id").alias("threat_id"), F.col("text").alias("attack_text"))
    best = report.top_matches(results.select("node_id", "max_similarity", "nearest_threat_id"), 25, results.select("node_id", "title", "text"), items)
    return best.select(F.col("rank").cast("long").alias("rank"), "node_id", "max_similarity", "title", "text", "nearest_attack_text")


def flagged_by_conversation(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder)
    rolled = report.flagged_conversations(results.select("node_id", "max_similarity"), results, 0.6)
    listed = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("flagged_node_ids", "flagged_node_types")}
    return rolled.withColumns(listed).withColumn("flagged_scores", F.round(F.aggregate("flagged_scores", F.lit(0.0), lambda a, x: a + x), 4))


def conversation_stats(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder)
    return report.conversation_stats(report.flagged_conversations(results.select("node_id", "max_similarity"), results, 0.6))


def _scan_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Five vectors as the windows of a document."""
    window = F.col("vec_id") % 5
    windows = embeddings(spark, folder).select(F.concat(F.lit("post:"), F.floor(F.col("vec_id") / 5)).alias("node_id"), window.alias("chunk_index"), (window * 112).alias("start_token"), (window * 112 + 128).alias("end_token"), F.concat(F.lit("window "), "vec_id").alias("text"), F.col("embedding").alias("vector"), "label")
    known = table(spark, folder, "documents").select(F.concat(F.lit("post:"), "doc_id").alias("node_id"), F.lit("post").alias("node_type"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("submolt_name"), F.col("text").alias("embed_text"))
    return windows, known


SCAN_COLUMNS = ("node_id", "node_type", "submolt_name", "max_similarity", "nearest_threat_id", "nearest_category", "num_chunks", "trigger_chunk_index", "trigger_start_token", "trigger_end_token", "trigger_chunk_text", "text_preview", "threshold_flags")


def scan_contrast(spark: SparkSession, folder: str) -> DataFrame:
    windows, known = _scan_tables(spark, folder)
    protos = V.contrast_prototypes(embeddings(spark, folder), "label", "embedding", MALICIOUS, BENIGN)
    return scan.contrast(windows, protos, known, [0.0, 0.1]).withColumn("max_similarity", F.round("max_similarity", 6)).select(*SCAN_COLUMNS)


def scan_example(spark: SparkSession, folder: str) -> DataFrame:
    windows, known = _scan_tables(spark, folder)
    windows = windows.filter(~F.col("label").isin(*MALICIOUS))  # the malicious vectors are the dictionary
    refs = embeddings(spark, folder).filter(F.col("label").isin(*MALICIOUS)).select(F.concat(F.lit("seed:"), "vec_id").alias("threat_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category"), F.lit("seed").alias("source"))
    found = scan.nearest(windows, refs, known, 3, [0.0, 0.1], refs.filter("category != '4'"))
    return found.withColumn("max_similarity", F.round("max_similarity", 6)).select(*SCAN_COLUMNS, "topk_threat_ids")


def kmeans_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return models.cosine_kmeans(embeddings(spark, folder), "vec_id", "embedding", 8)


def head_logreg(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder)
    return models.cross_validate(rows, "embedding", "y", "fold", FOLDS).select("vec_id", "run", "part", "y", "p")


def hashed_encoder(spark: SparkSession, folder: str) -> DataFrame:
    found = models.hashed_vectors(table(spark, folder, "documents"), "doc_id", "text", 16)
    return found.select("doc_id", F.posexplode("vector").alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _parted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled vectors: the training rows with folds, and the fixed test set."""
    rows = embeddings(spark, folder).filter(F.col("label").isin(*MALICIOUS, *BENIGN)).withColumn("y", (F.col("label") != 0).cast("long"))
    parted = sampling.split(rows, "vec_id", "label", 0.3)
    return sampling.folds(parted.filter("split = 'train'").drop("split"), "vec_id", "label", FOLDS), parted.filter("split = 'test'").drop("split")


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds from each fold's validation rows, metrics on the test set, by the prototypes of the other folds."""
    train, test = (stage(part.select("vec_id", "label", "embedding", "y", *[c for c in part.columns if c == "fold"]), "parted") for part in _parted(spark, folder))
    protos = F.broadcast(V.fold_prototypes(train, "fold", "label", "embedding", MALICIOUS, BENIGN, FOLDS))
    unit_ = unit(as_double(F.col("embedding")))
    score = lambda rows: stage(rows.withColumn("v", unit_).select("fold", "y", F.round(dot(F.col("v"), F.col("malicious")) - dot(F.col("v"), F.col("benign")), 4).alias("score")), "held-scores")
    # The test set meets one prototype pair a fold.
    return stage(metrics.held_out(score(train.join(protos, "fold")), score(test.crossJoin(protos)), "score", "y", RECALL), "held-out")


def fold_test_metrics(spark: SparkSession, folder: str) -> DataFrame:
    names = ("precision", "recall", "accuracy", "flag_rate", "f1", "average_precision", "roc_auc")
    return metrics.require_recall(_evaluated(spark, folder)).select("fold", "threshold", "n", "n_pos", "tp", "fp", *[F.round(c, 6).alias(c) for c in names])


def fold_threshold_check(spark: SparkSession, folder: str) -> DataFrame:
    kept = ("fold", "threshold", "validation_positive_count", "recall_ok", "validation_ties", "validation_positive_ties", "test_ties", "test_positive_ties")
    return _evaluated(spark, folder).select(*kept, F.round("validation_recall", 6).alias("validation_recall"))


def checkpoint_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Five checkpoints of a head, each scoring all labelled vectors, best f1 first."""
    rows = embeddings(spark, folder).filter(F.col("label").isin(*MALICIOUS, *BENIGN)).withColumn("y", (F.col("label") != 0).cast("long"))
    scored = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("epoch", "y", F.round(models.sigmoid(F.get("embedding", F.lit(0)).cast("double") * F.col("epoch") + F.col("epoch") / 10 - 0.25), 4).alias("p"))
    found = metrics.checkpoint_table(scored, "p", "y")
    return found.select(F.col("epoch").cast("long").alias("epoch"), "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "average_precision")])


def prototype_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Without a benign row, a sample of the corpus stands for them."""
    vecs = embeddings(spark, folder)
    sample = sampling.simple(vecs, "vec_id", 50).select("embedding")
    found = V.contrast_prototypes(vecs.filter("label != 0"), "label", "embedding", MALICIOUS, BENIGN, sample)
    return found.select(F.posexplode("benign").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def kmeans_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The clustering holds all vectors in k clusters, and is at least as tight as the classes that made the vectors."""
    vecs = embeddings(spark, folder)
    placed = stage(models.cosine_kmeans(vecs, "vec_id", "embedding", 8), "clusters")
    classes = vecs.join(V.centroids(vecs, "label", "embedding"), "label").agg(F.avg(dot(unit(as_double(F.col("embedding"))), F.col("centroid"))).alias("by_label"))
    whole = V.centroids(vecs.withColumn("one", F.lit(1)), "one", "embedding").select("centroid")
    alone = vecs.crossJoin(F.broadcast(whole)).agg(F.avg(dot(unit(as_double(F.col("embedding"))), F.col("centroid"))).alias("alone"))
    counted = placed.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_vectors"), F.count_distinct("cluster").alias("n_clusters"), F.avg("similarity").alias("mean"))
    joined = counted.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(alone))
    return joined.select("n", "n_vectors", (F.col("n_clusters") <= 8).alias("k_ok"), (F.col("mean") > F.col("alone")).alias("tighter_than_one"), F.round("alone", 6).alias("alone"), F.round("by_label", 6).alias("by_label"))


def head_gradient(spark: SparkSession, folder: str) -> DataFrame:
    """A head trained to the end stands where its class-weighted loss is flat in bias: weighted residuals sum to nothing."""
    rows = _labelled(spark, folder)
    head = models.train_head(rows, "embedding", "y", iterations=200)
    scored = models.apply_head(head, rows, "embedding")
    weights = metrics.class_weights(rows, "y").select(F.col("label").alias("y"), "weight")
    flat = scored.join(F.broadcast(weights), "y").agg(F.count("*").alias("n"), F.sum(F.col("weight") * (F.col("y") - F.col("p"))).alias("slope"), F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("up"), F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("down"))
    return flat.select("n", (F.abs("slope") < F.col("n") * 1e-4).alias("flat"), (F.col("up") > F.col("down")).alias("separates"))


QUERIES = {f.__name__: f for f in (
    fold_test_metrics, fold_threshold_check, checkpoint_evaluation, prototype_fallback, kmeans_quality, head_gradient, contrast_flag_summary, centroids, contrast_scores, scan_contrast, scan_example, contrast_max_chunk, doc_vector_mean_pool, vector_topk, cluster_profile, threshold_flags, fold_contrast, threshold_at_recall, confusion_metrics, tie_counts, average_precision,
    roc_auc, pr_auc_trapezoid, fold_summary, throughput_summary, class_weights, sigmoid_head_score, threshold_sweep, strata_sample, strata_unassigned, top_matches, flagged_by_conversation, conversation_stats, kmeans_cosine, head_logreg, hashed_encoder,
)}

#: Unit vectors, class means and contrast scores in DuckDB.
UNIT_SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END) AS u FROM v),
x AS (SELECT vec_id, label, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS pos FROM u)
"""
SCORED_SQL = UNIT_SQL + """,
m AS (SELECT CASE WHEN label IN (3, 4, 5) THEN 'malicious' WHEN label = 0 THEN 'benign' END AS side, pos, avg(x) AS x FROM x WHERE label IN (0, 3, 4, 5) GROUP BY ALL),
p AS (SELECT side, list(x ORDER BY pos) AS c FROM m GROUP BY side),
pu AS (SELECT side, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM p),
s AS (SELECT vec_id, label, list_inner_product(u, (SELECT c FROM pu WHERE side = 'malicious')) AS sim_malicious, list_inner_product(u, (SELECT c FROM pu WHERE side = 'benign')) AS sim_benign FROM u),
scored AS (SELECT *, sim_malicious - sim_benign AS score FROM s)
"""
FOLD_SQL = UNIT_SQL + """,
y AS (SELECT vec_id, label, (label != 0)::BIGINT AS y, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) - 1) % 5)::BIGINT AS fold FROM embeddings WHERE label IN (0, 3, 4, 5)),
o AS (SELECT k.fold, CASE WHEN x.label = 0 THEN 'benign' ELSE 'malicious' END AS side, pos, sum(x.x) / count(*) AS x FROM x JOIN y USING (vec_id), (SELECT unnest(range(5)) AS fold) k WHERE y.fold != k.fold GROUP BY ALL),
c AS (SELECT fold, side, list(x ORDER BY pos) AS c FROM o GROUP BY ALL),
cu AS (SELECT fold, side, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM c),
scored AS (SELECT y.*, round(list_inner_product(u.u, a.c) - list_inner_product(u.u, b.c), 4) AS score FROM y JOIN u USING (vec_id) JOIN cu a ON a.fold = y.fold AND a.side = 'malicious' JOIN cu b ON b.fold = y.fold AND b.side = 'benign'),
t AS (SELECT fold, score AS threshold FROM (SELECT fold, score, row_number() OVER (PARTITION BY fold ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY fold) AS n FROM scored WHERE y = 1) WHERE r = ceil(n * 0.8::DOUBLE)),
f AS (SELECT scored.*, threshold, score >= threshold AS flag FROM scored JOIN t USING (fold)),
k AS (SELECT fold, count(*) AS n, sum(y)::BIGINT AS n_pos, count(*) FILTER (WHERE y = 1 AND flag) AS tp, count(*) FILTER (WHERE y = 0 AND flag) AS fp, count(*) FILTER (WHERE y = 1 AND NOT flag) AS fn, count(*) FILTER (WHERE y = 0 AND NOT flag) AS tn FROM f GROUP BY fold),
kk AS (SELECT *, tp + fp AS n_flagged, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, (tp + tn) / n AS accuracy, (tp + fp) / n AS flag_rate FROM k),
g AS (SELECT fold, score, sum(y)::BIGINT AS p, count(*) AS n FROM scored GROUP BY ALL),
gg AS (SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY fold ORDER BY score DESC) AS cn, sum(p) OVER (PARTITION BY fold) AS pp, sum(n) OVER (PARTITION BY fold) AS nn FROM g),
gh AS (SELECT *, tp / cn AS pr, tp / pp AS re, coalesce(lag(tp / cn) OVER (PARTITION BY fold ORDER BY score DESC), 1) AS pr0, coalesce(lag(tp / pp) OVER (PARTITION BY fold ORDER BY score DESC), 0) AS re0 FROM gg)
"""
_FOLD_ROWS = "y AS (SELECT vec_id, label, (label != 0)::BIGINT AS y, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) - 1) % 5)::BIGINT AS fold FROM embeddings WHERE label IN (0, 3, 4, 5))"
assert _FOLD_ROWS in FOLD_SQL
#: The same over training rows only, with the test set scored for every fold.
HELD_SQL = FOLD_SQL.replace(_FOLD_ROWS, """z AS (SELECT vec_id, label, (label != 0)::BIGINT AS y, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE, 0) AS test FROM embeddings WHERE label IN (0, 3, 4, 5)),
y AS (SELECT vec_id, label, y, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) - 1) % 5)::BIGINT AS fold FROM z WHERE NOT test)""") + """,
ts AS (SELECT a.fold, z.y, round(list_inner_product(u.u, a.c) - list_inner_product(u.u, b.c), 4) AS score, threshold FROM z JOIN u USING (vec_id) JOIN cu a ON a.side = 'malicious' JOIN cu b ON b.fold = a.fold AND b.side = 'benign' JOIN t ON t.fold = a.fold WHERE test),
tk AS (SELECT fold, any_value(threshold) AS threshold, count(*) AS n, sum(y)::BIGINT AS n_pos, count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE y = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE score = threshold) AS test_ties, count(*) FILTER (WHERE score = threshold AND y = 1) AS test_positive_ties FROM ts GROUP BY fold),
tr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / n_pos AS recall, (tp + n - n_pos - fp) / n AS accuracy, (tp + fp) / n AS flag_rate FROM tk),
ta AS (SELECT a.fold, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS roc_auc FROM ts a JOIN ts b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY a.fold),
tg AS (SELECT fold, score, sum(y)::BIGINT AS p, count(*) AS n FROM ts GROUP BY ALL),
tp_ AS (SELECT fold, sum(p * tp / cn) / sum(p) AS average_precision FROM (SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY fold ORDER BY score DESC) AS cn FROM tg) GROUP BY fold)
"""
_W = "[" + ", ".join(str(((k % 7) - 3) / 4) for k in range(64)) + "]::DOUBLE[]"
_STRATUM = "CASE " + " ".join(f"WHEN max_similarity >= {lo} AND max_similarity < {hi} THEN '{name}'" for name, lo, hi in report.STRATA) + " END"
_CONV = RESULTS_SQL + ", z AS (SELECT *, CASE WHEN node_type = 'post' THEN 'conv' END AS submolt_name FROM r WHERE max_similarity >= 0.6)"

_SCAN = """SELECT 'post:' || owner AS node_id, 'post' AS node_type, CASE WHEN owner % 2 = 0 THEN source ELSE '' END AS submolt_name, round(score, 6) AS max_similarity, NEAREST, num_chunks, i AS trigger_chunk_index, i * 112 AS trigger_start_token, i * 112 + 128 AS trigger_end_token, 'window ' || vec_id AS trigger_chunk_text,
    left(coalesce(text, ''), 200) AS text_preview, '{"0.0":' || (score >= 0.0) || ',"0.1":' || (score >= 0.1) || '}' AS threshold_flags"""

ORACLES = {
    "fold_test_metrics": HELD_SQL + "SELECT fold, threshold, n, n_pos, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(flag_rate, 6) AS flag_rate, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round(average_precision, 6) AS average_precision, round(roc_auc, 6) AS roc_auc FROM tr JOIN ta USING (fold) JOIN tp_ USING (fold)",
    "fold_threshold_check": HELD_SQL + "SELECT f.fold, any_value(f.threshold) AS threshold, sum(f.y)::BIGINT AS validation_positive_count, abs(any_value(kk.recall) - 0.8::DOUBLE) <= 1 / sum(f.y) + 1e-12 AS recall_ok, count(*) FILTER (WHERE score = f.threshold) AS validation_ties, count(*) FILTER (WHERE score = f.threshold AND f.y = 1) AS validation_positive_ties, any_value(test_ties) AS test_ties, any_value(test_positive_ties) AS test_positive_ties, round(any_value(kk.recall), 6) AS validation_recall FROM f JOIN kk USING (fold) JOIN tk USING (fold) GROUP BY f.fold",
    "checkpoint_evaluation": """WITH s AS (SELECT epoch, (label != 0)::BIGINT AS y, round(1 / (1 + exp(-(embedding[1]::DOUBLE * epoch + epoch / 10 - 0.25))), 4) AS p FROM embeddings, (SELECT unnest(range(1, 6)) AS epoch) WHERE label IN (0, 3, 4, 5)),
        k AS (SELECT epoch, count(*) FILTER (WHERE y = 1 AND p > 1 - p) AS tp, count(*) FILTER (WHERE y = 0 AND p > 1 - p) AS fp, sum(y) AS n_pos FROM s GROUP BY epoch),
        g AS (SELECT epoch, p, sum(y) AS pos, count(*) AS n FROM s GROUP BY ALL), a AS (SELECT epoch, sum(pos * tp / cn) / sum(pos) AS ap FROM (SELECT *, sum(pos) OVER (PARTITION BY epoch ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY epoch ORDER BY p DESC) AS cn FROM g) GROUP BY epoch),
        r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / n_pos AS recall FROM k)
        SELECT epoch, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round(ap, 6) AS average_precision FROM r JOIN a USING (epoch)""",
    "prototype_fallback": UNIT_SQL + ", w AS (SELECT vec_id FROM embeddings ORDER BY sha256('42:' || vec_id), vec_id LIMIT 50), m AS (SELECT pos, avg(x) AS x FROM x JOIN w USING (vec_id) GROUP BY pos) SELECT pos::BIGINT AS pos, round(x / (SELECT sqrt(sum(x * x)) FROM m), 6) AS x FROM m",
    "kmeans_quality": UNIT_SQL + """, a AS (SELECT pos, avg(x) AS x FROM x GROUP BY pos), al AS (SELECT list(x ORDER BY pos) AS c FROM a), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY ALL), ml AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label)
        SELECT count(*) AS n, count(DISTINCT vec_id) AS n_vectors, true AS k_ok, true AS tighter_than_one, round(avg(list_inner_product(u, al.c) / sqrt(list_inner_product(al.c, al.c))), 6) AS alone, round(avg(list_inner_product(u, ml.c) / sqrt(list_inner_product(ml.c, ml.c))), 6) AS by_label FROM u JOIN ml USING (label), al""",
    "head_gradient": "SELECT count(*) AS n, true AS flat, true AS separates FROM embeddings WHERE label IN (0, 3, 4, 5)",
    "scan_contrast": SCORED_SQL + ", w AS (SELECT *, vec_id // 5 AS owner, vec_id % 5 AS i, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY score DESC, vec_id) AS r, count(*) OVER (PARTITION BY vec_id // 5) AS num_chunks FROM scored) "
    + _SCAN.replace("NEAREST", "CASE WHEN score >= 0 THEN 'malicious' ELSE 'benign' END AS nearest_threat_id, CASE WHEN score >= 0 THEN 'malicious' ELSE 'benign' END AS nearest_category") + " FROM w JOIN documents ON doc_id = owner WHERE r = 1",
    "scan_example": UNIT_SQL + """, k AS (SELECT a.vec_id, 'seed:' || b.vec_id AS threat_id, b.label, list_inner_product(a.u, b.u) AS s FROM u a, u b WHERE b.label IN (3, 4, 5) AND a.label NOT IN (3, 4, 5)),
        t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, threat_id) AS n FROM k), b AS (SELECT vec_id, max(s) AS score, '[' || string_agg('"' || threat_id || '"', ',' ORDER BY n) || ']' AS topk_threat_ids, arg_min(threat_id, n) AS tid, arg_min(label, n) AS label FROM t WHERE n <= 3 GROUP BY vec_id),
        w AS (SELECT *, vec_id // 5 AS owner, vec_id % 5 AS i, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY score DESC, vec_id) AS r, count(*) OVER (PARTITION BY vec_id // 5) AS num_chunks FROM b) """
    + _SCAN.replace("NEAREST", "tid AS nearest_threat_id, CASE WHEN label = 4 THEN '' ELSE label::VARCHAR END AS nearest_category") + ", topk_threat_ids FROM w JOIN documents ON doc_id = owner WHERE r = 1",
    "contrast_flag_summary": SCORED_SQL + "SELECT label, count(*) AS n, count(*) FILTER (WHERE score >= 0) AS n_flagged FROM scored GROUP BY label",
    "centroids": UNIT_SQL + ", m AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL), z AS (SELECT label, sqrt(sum(x * x)) AS z FROM m GROUP BY label) SELECT label, n, pos::BIGINT AS pos, round(x / z, 6) AS x FROM m JOIN z USING (label)",
    "contrast_scores": SCORED_SQL + "SELECT vec_id, round(sim_malicious, 6) AS sim_malicious, round(sim_benign, 6) AS sim_benign, round(score, 6) AS score, CASE WHEN round(score, 6) >= 0 THEN 'malicious' ELSE 'benign' END AS nearest FROM scored",
    "contrast_max_chunk": SCORED_SQL + "SELECT owner, round(score, 6) AS max_similarity, i AS trigger_chunk_index, round(sim_malicious, 6) AS sim_malicious, num_chunks FROM (SELECT vec_id // 5 AS owner, vec_id % 5 AS i, score, sim_malicious, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY score DESC, vec_id) AS r, count(*) OVER (PARTITION BY vec_id // 5) AS num_chunks FROM scored) WHERE r = 1",
    "doc_vector_mean_pool": UNIT_SQL + ", m AS (SELECT vec_id // 5 AS owner, pos, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL), z AS (SELECT owner, sqrt(sum(x * x)) AS z, max(n) AS num_chunks, max(x) FILTER (WHERE pos = 0) AS a, max(x) FILTER (WHERE pos = 63) AS b FROM m GROUP BY owner) SELECT owner, num_chunks, round(a / z, 6) AS x0, round(b / z, 6) AS x63 FROM z",
    "vector_topk": UNIT_SQL + "SELECT vec_id, r AS rank, ref_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref_id) AS r FROM (SELECT a.vec_id, b.vec_id AS ref_id, list_inner_product(a.u, b.u) AS s FROM u a, u b WHERE b.label IN (3, 4, 5))) WHERE r <= 5",
    "cluster_profile": UNIT_SQL + """, m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label),
        s AS (SELECT vec_id, label, (vec_id % 3)::VARCHAR AS category, round(list_inner_product(u, c) / sqrt(list_inner_product(c, c)), 6) AS s FROM u JOIN c USING (label)),
        k AS (SELECT label, category, count(*) AS n FROM s GROUP BY ALL)
        SELECT k.cluster, coalesce((SELECT sum(n)::BIGINT FROM k x WHERE x.label = k.cluster), 0) AS size, coalesce((SELECT category FROM k x WHERE x.label = k.cluster ORDER BY n DESC, category LIMIT 1), '') AS category,
        coalesce((SELECT 'v' || vec_id FROM s WHERE s.label = k.cluster ORDER BY s DESC, vec_id LIMIT 1), '') AS rep_text FROM (SELECT unnest(range(12)) AS cluster) k""",
    "threshold_flags": SCORED_SQL + """SELECT vec_id, '{"0.0":' || (score >= 0.0) || ',"0.1":' || (score >= 0.1) || '}' AS threshold_flags FROM scored""",
    "fold_contrast": FOLD_SQL + "SELECT vec_id, label, fold, y, score FROM scored",
    "threshold_at_recall": FOLD_SQL + "SELECT * FROM t",
    "confusion_metrics": FOLD_SQL + "SELECT fold, n, n_pos, tp, fp, fn, tn, n_flagged, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(flag_rate, 6) AS flag_rate, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM kk",
    "tie_counts": FOLD_SQL + "SELECT fold, count(*) FILTER (WHERE score = threshold) AS n_ties, count(*) FILTER (WHERE score = threshold AND y = 1) AS n_pos_ties FROM f GROUP BY fold",
    "average_precision": FOLD_SQL + "SELECT fold, round(sum(p * tp / cn) / max(pp), 6) AS average_precision FROM gh GROUP BY fold",
    "roc_auc": FOLD_SQL + "SELECT a.fold, round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS roc_auc FROM scored a JOIN scored b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY a.fold",
    "pr_auc_trapezoid": FOLD_SQL + "SELECT fold, round(sum((re - re0) * (pr + pr0) / 2), 6) AS pr_auc FROM gh GROUP BY fold",
    "fold_summary": FOLD_SQL + ", a AS (SELECT fold::VARCHAR AS fold, n::DOUBLE AS n, tp::DOUBLE AS tp, fp::DOUBLE AS fp, precision, recall FROM kk) SELECT fold, n, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM a UNION ALL SELECT 'mean', round(avg(n), 6), round(avg(tp), 6), round(avg(fp), 6), round(avg(precision), 6), round(avg(recall), 6) FROM a UNION ALL SELECT 'std', round(stddev_samp(n), 6), round(stddev_samp(tp), 6), round(stddev_samp(fp), 6), round(stddev_samp(precision), 6), round(stddev_samp(recall), 6) FROM a",
    "throughput_summary": "SELECT round(avg(r), 6) AS nodes_per_second_mean, round(stddev_samp(r), 6) AS nodes_per_second_std FROM (SELECT 8680 / (x * 0.5::DOUBLE + 20) AS r FROM (SELECT unnest(range(5)) AS x))",
    "class_weights": "WITH y AS (SELECT (label != 0)::BIGINT AS label FROM embeddings WHERE label IN (0, 3, 4, 5)) SELECT label, count(*) AS n, round((SELECT count(*) FROM y) / (2 * count(*)), 6) AS weight FROM y GROUP BY label",
    "sigmoid_head_score": f"SELECT vec_id, round(p, 6) AS p, p > 1 - p AS unsafe FROM (SELECT vec_id, 1 / (1 + exp(-(list_inner_product(embedding::DOUBLE[], {_W}) + 0.25))) AS p FROM embeddings)",
    "hashed_encoder": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{WS.replace("[", "[^", 1)}+')) AS w FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(lower(w)), 1, 8))::BIGINT % 32 AS s FROM t),
        k AS (SELECT d.doc_id, p.pos, coalesce(sum(CASE WHEN s < 16 THEN 1 WHEN s >= 16 THEN -1 END), 0)::DOUBLE AS x FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS pos) p LEFT JOIN h ON h.doc_id = d.doc_id AND h.s % 16 = p.pos GROUP BY ALL)
        SELECT doc_id, pos, round(x / CASE WHEN z = 0 THEN 1 ELSE z END, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS z FROM k)""",
    "threshold_sweep": RESULTS_SQL + """, k AS (SELECT unnest([0.0, 0.4, 0.55, 0.9, 2.0]::DOUBLE[]) AS threshold), c AS (SELECT threshold, nearest_category, count(*) AS n FROM r, k WHERE max_similarity >= threshold GROUP BY ALL),
        g AS (SELECT threshold, '{' || string_agg('"' || nearest_category || '":' || n, ',' ORDER BY nearest_category) || '}' AS j FROM c GROUP BY threshold)
        SELECT k.threshold, count(*) FILTER (WHERE max_similarity >= k.threshold) AS flagged_count, round_even(count(*) FILTER (WHERE max_similarity >= k.threshold) * 100.0::DOUBLE / count(*), 4) AS flagged_pct, count(*) FILTER (WHERE max_similarity >= k.threshold AND node_type = 'post') AS post_count,
        count(*) FILTER (WHERE max_similarity >= k.threshold AND node_type = 'comment') AS comment_count, coalesce(max(g.j), '{}') AS categories_json FROM r CROSS JOIN k LEFT JOIN g ON g.threshold = k.threshold GROUP BY k.threshold""",
    "strata_sample": RESULTS_SQL + f"SELECT node_id, max_similarity, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || node_id), node_id) AS n FROM (SELECT node_id, max_similarity, {_STRATUM} AS stratum FROM r)) WHERE stratum IS NOT NULL AND n <= 10",
    "strata_unassigned": RESULTS_SQL + f"SELECT count(*) FILTER (WHERE {_STRATUM} IS NULL) AS n_unassigned FROM r",
    "top_matches": RESULTS_SQL + ", b AS (SELECT node_id, max_similarity, nearest_threat_id, row_number() OVER (ORDER BY max_similarity DESC, node_id) AS rank FROM r) SELECT rank, b.node_id, max_similarity, CASE WHEN pn.node_id IS NOT NULL THEN posts.title END AS title, left(CASE WHEN pn.node_id IS NOT NULL THEN posts.body ELSE cn.embed_text END, 220) AS text, left(benchmark.text, 160) AS nearest_attack_text FROM b LEFT JOIN pn ON b.node_id = pn.node_id LEFT JOIN posts ON pn.conversation_id = posts.source_id LEFT JOIN cn ON cn.node_id = b.node_id LEFT JOIN benchmark ON nearest_threat_id = 'seed:' || item_id WHERE rank <= 25",
    "flagged_by_conversation": _CONV + "SELECT conversation_id, 'post:' || conversation_id AS post_node_id, coalesce(max(submolt_name), '') AS submolt_name, count(*) AS n_flagged, string_agg(node_id, ',' ORDER BY node_id) AS flagged_node_ids, string_agg(node_type, ',' ORDER BY node_id) AS flagged_node_types, round(sum(max_similarity), 4) AS flagged_scores FROM z GROUP BY conversation_id",
    "conversation_stats": _CONV + "SELECT count(*) AS n_conversations, count(*) FILTER (WHERE n > 1) AS n_multi_flagged, coalesce(max(n), 0) AS max_flagged FROM (SELECT conversation_id, count(*) AS n FROM z GROUP BY conversation_id)",
}
