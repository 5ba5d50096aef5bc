"""A published dataset on a shared path: revisions, and its nodes looked up in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.functions.text import compose
from lakewarden.operators.contracts import ContractError, hash_mismatches, require_none
from lakewarden.operators.judge import severity_text


def resolve_revision(spark: SparkSession, mirror: str, revision: str) -> str:
    """The commit that ``<mirror>/refs/<revision>`` names; the given text if there is none. Provenance only, so no error stops a run."""
    try:
        found = spark.read.text(f"{mirror}/refs/{revision}").first()
        return (found.value.strip() if found else "") or revision
    except Exception:
        return revision


def locate(spark: SparkSession, mirror: str, revision: str, name: str, override: str | None = None) -> dict[str, str]:
    """Where to read a published file, and what to say about it: a local file wins over ``<mirror>/snapshots/<commit>/<name>``."""
    if override:
        return {"source_type": "local_file", "path": override}
    commit = resolve_revision(spark, mirror, revision)
    return {"source_type": "mirror", "path": f"{mirror}/snapshots/{commit}/{name}", "revision": commit}


def sync_nodes(ids: DataFrame, corpus: DataFrame) -> DataFrame:
    """Nodes of the listed ids with their composed text, checked. Starts jobs.

    ids: node_id, optionally text_sha256. A listed node that the corpus lacks, a
    node type beside post and comment, and a text whose hash is not the listed
    one are errors.
    """
    require_none(ids.join(corpus, "node_id", "left_anti").select("node_id"), "listed nodes that the corpus lacks")
    found = ids.join(corpus.drop("text_sha256"), "node_id")
    require_none(found.filter(~F.coalesce("node_type", F.lit("")).isin("post", "comment")).select("node_id", "node_type"), "unknown node types")
    made = found.withColumn("embed_text", compose(F.col("node_type"), F.col("title"), F.col("text")))
    if "text_sha256" in ids.columns:
        require_none(hash_mismatches(made, "embed_text", "text_sha256").select("node_id"), "texts of another hash")
        return made.drop("text_sha256")
    return made


def with_severity(nodes: DataFrame, judged: DataFrame) -> DataFrame:
    """Nodes with their severity as text, empty where not judged; a node judged twice is an error."""
    require_none(judged.groupBy("node_id").count().filter("count > 1").select("node_id"), "nodes judged twice")
    known = judged.select("node_id", severity_text(F.col("severity")).alias("severity"))
    return nodes.drop("severity").join(known, "node_id", "left").na.fill("", ["severity"])


def same_severity(assigned: DataFrame, judged: DataFrame) -> DataFrame:
    """An assignment whose severities are those of the verdicts, else an error with the nodes that differ."""
    left, right = assigned.select("node_id", F.col("severity").alias("_a")), judged.select("node_id", severity_text(F.col("severity")).alias("_b"))
    try:
        require_none(left.join(right, "node_id", "left").filter(~F.col("_a").eqNullSafe(F.col("_b"))), "severities that differ")
    except ContractError as error:
        raise ContractError(f"assignment and verdicts disagree: {error}") from error
    return assigned

