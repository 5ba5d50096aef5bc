"""Command line: the stages of the analysis over Parquet, CSV and JSON lines.

    python -m lakewarden.cli prep-data --posts P --comments C --out O
    python -m lakewarden.cli language-filter --nodes N --chunks L --out O
    python -m lakewarden.cli judge-sample --nodes N --n 100 --out O
    python -m lakewarden.cli judge-requests --input I --prompt FILE --model M --out O
    python -m lakewarden.cli judge-fetch --input I --responses R --out O
    python -m lakewarden.cli judge-merge --base B --retry R --out O
    python -m lakewarden.cli sync-nodes --nodes N --ids I --out O
    python -m lakewarden.cli prepare-folds --verdicts V --k 5 --test-fraction 0.3 --out O
    python -m lakewarden.cli eval-contrast --vectors V --folds F --out O
    python -m lakewarden.cli eval-head --vectors V --folds F --out O
    python -m lakewarden.cli build-index --vectors V --mode contrast|cluster|example --out O
    python -m lakewarden.cli scan --windows W --index I --nodes N --mode contrast|cluster|example --out O
    python -m lakewarden.cli windows --nodes N --out O
    python -m lakewarden.cli report --scan S --nodes N --out O

Remote submission, status and cancellation of judge batches are left to the
provider's own client: requests are written and responses read as files.
Existing output is refused without --overwrite.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lakewarden.operators import chunks, judge, language, metrics, models, nodes, report, sampling, scan, vectors as V
from lakewarden.sources import readers, sinks

MALICIOUS, BENIGN = ("3", "4", "5"), ("0",)
COMMANDS: dict[str, tuple[Callable, tuple[str, ...]]] = {}


def command(name: str, *needed: str):
    def add(f: Callable) -> Callable:
        COMMANDS[name] = (f, needed)
        return f

    return add


def save(df: DataFrame, a: argparse.Namespace, part: str = "") -> None:
    sinks.parquet(df, f"{a.out}/{part}" if part else a.out, overwrite=a.overwrite)


@command("prep-data", "posts", "comments")
def prep_data(spark: SparkSession, a: argparse.Namespace) -> None:
    save(nodes.corpus(spark.read.parquet(a.posts), spark.read.parquet(a.comments)), a)


@command("language-filter", "nodes", "chunks")
def language_filter(spark: SparkSession, a: argparse.Namespace) -> None:
    """chunks: node_id, node_type, chunk_index, language, n_chars of a detector."""
    found = spark.read.parquet(a.chunks)
    summary = language.node_summary(found)
    units = summary.select("node_type", F.col("dominant_language").alias("language"), "n_chars")
    save(summary, a, "languages")
    save(language.distribution(found, "chunk").unionByName(language.distribution(units, "node_dominant")), a, "distribution")
    save(language.english_only(language.attach(spark.read.parquet(a.nodes), summary), a.min_frac), a, "english")


@command("judge-sample", "nodes")
def judge_sample(spark: SparkSession, a: argparse.Namespace) -> None:
    df = spark.read.parquet(a.nodes).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    drawn = sampling.simple(df, "node_id", a.n, a.seed)
    place = F.row_number().over(Window.orderBy(sampling.draw(a.seed, "node_id"), "node_id"))
    sinks.csv(drawn.withColumns({"example_num": place, "is_truncated": F.lit(False)}), a.out, ["example_num", "node_id", "node_type", "title", "text", "is_truncated"], a.overwrite, single=True)


@command("judge-requests", "input", "prompt")
def judge_requests(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.csv_text(spark, a.input)
    prompt = readers.prompt("\n".join(r.value for r in spark.read.text(a.prompt).collect()))
    sinks.json_lines(rows.select(judge.request_line(rows, prompt, a.model, a.effort).alias("value")), a.out, a.overwrite)


@command("judge-fetch", "input", "responses")
def judge_fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    asked = readers.csv_text(spark, a.input).select("example_num", "node_id", "node_type")
    got = judge.parse_responses(spark.read.text(a.responses))
    ok = got.filter("status_code = 200").select("node_id", judge.parse_verdict(F.col("output_text")).alias("v"), "cached_tokens", "input_tokens", "output_tokens", "reasoning_tokens").select("node_id", "v.*", "cached_tokens", "input_tokens", "output_tokens", "reasoning_tokens")
    bad = got.filter("status_code is null or status_code != 200").select("node_id")
    all_ = judge.reconcile(asked, ok, bad).join(asked, "node_id", "left")
    verdict = F.when(F.col("outcome") == "success", F.col("verdict")).otherwise("error")
    extra = {"verdict": verdict, "ok": F.col("outcome") == "success", "model": F.lit(a.model), "reasoning_effort": F.lit(a.effort)}
    sinks.csv(all_.withColumns(extra), a.out, list(judge.RESULT_COLUMNS), a.overwrite)


@command("judge-merge", "base", "retry")
def judge_merge(spark: SparkSession, a: argparse.Namespace) -> None:
    base, retry = readers.csv_text(spark, a.base), readers.csv_text(spark, a.retry)
    if judge.unknown_retries(base, retry).limit(1).count():
        raise SystemExit("the retry has ids that the base lacks")
    sinks.csv(judge.merge_retry(base, retry), a.out, overwrite=a.overwrite)


@command("sync-nodes", "nodes", "ids")
def sync_nodes(spark: SparkSession, a: argparse.Namespace) -> None:
    save(spark.read.parquet(a.nodes).join(readers.id_list(spark, a.ids), "node_id", "left_semi"), a)


@command("prepare-folds", "verdicts")
def prepare_folds(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.csv_text(spark, a.verdicts).select("node_id", judge.severity_text(F.col("severity")).alias("severity")).filter(F.col("severity").isin(*MALICIOUS, *BENIGN))
    parted = sampling.split(rows, "node_id", "severity", a.test_fraction, a.seed)
    save(sampling.folds(parted.filter("split = 'train'").drop("split"), "node_id", "severity", a.k, a.seed), a, "folds")
    save(parted.filter("split = 'test'"), a, "test")


def _evaluated(scored: DataFrame, a: argparse.Namespace) -> DataFrame:
    limits = metrics.threshold_at_recall(scored, "score", "y", a.recall, ["fold"])
    flagged = scored.join(limits, "fold").withColumn("flag", F.col("score") >= F.col("threshold"))
    return metrics.confusion(flagged, "y", "flag", ["fold"]).join(metrics.ranking(scored, "score", "y", ["fold"]), "fold")


@command("eval-contrast", "vectors", "folds")
def eval_contrast(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.vectors).join(spark.read.parquet(a.folds), "node_id").withColumn("y", judge.binary_label(F.col("severity")))
    protos = V.fold_prototypes(rows, "fold", "severity", "vector", MALICIOUS, BENIGN, a.k)
    unit = V.unit(V.as_double(F.col("vector")))
    scored = rows.join(F.broadcast(protos), "fold").withColumn("score", V.dot(unit, F.col("malicious")) - V.dot(unit, F.col("benign")))
    found = _evaluated(scored, a)
    save(metrics.fold_summary(found, [c for c in found.columns if c != "fold"]), a)


@command("eval-head", "vectors", "folds")
def eval_head(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.vectors).join(spark.read.parquet(a.folds), "node_id").withColumn("y", judge.binary_label(F.col("severity")))
    scored = models.cross_validate(rows, "vector", "y", "fold", a.k).withColumnRenamed("p", "score")
    found = _evaluated(scored, a)
    save(metrics.fold_summary(found, [c for c in found.columns if c != "fold"]), a)


@command("build-index", "vectors")
def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.vectors)
    if a.mode == "contrast":
        save(V.contrast_prototypes(rows, "severity", "vector", MALICIOUS, BENIGN), a)
    elif a.mode == "cluster":
        placed = models.cosine_kmeans(rows, "threat_id", "vector", a.k, a.seed)
        save(V.centroids(rows.join(placed, "threat_id"), "cluster", "vector").select(F.concat(F.lit("cluster:"), "cluster").alias("threat_id"), F.col("centroid").alias("vector"), "n"), a)
    else:
        save(rows.select("threat_id", "vector"), a)


@command("scan", "windows", "index", "nodes")
def scan_nodes(spark: SparkSession, a: argparse.Namespace) -> None:
    """windows: node_id, chunk_index, start_token, end_token, text, vector; one row a node comes out, by its best window."""
    windows, index, known = (spark.read.parquet(p) for p in (a.windows, a.index, a.nodes))
    if a.mode == "contrast":
        save(scan.contrast(windows, index, known, a.thresholds), a)
    else:
        save(scan.nearest(windows, index, known, a.top_k, a.thresholds), a)


@command("report", "scan", "nodes")
def make_report(spark: SparkSession, a: argparse.Namespace) -> None:
    found, known = spark.read.parquet(a.scan), spark.read.parquet(a.nodes)
    scored = found.withColumn("nearest_category", F.coalesce(F.nullif("nearest_category", F.lit("")), "nearest_threat_id"))
    sinks.csv(report.threshold_sweep(scored, a.thresholds).orderBy("threshold"), f"{a.out}/thresholds", overwrite=a.overwrite, single=True)
    sinks.csv(report.strata_sample(found, a.n, seed=a.seed), f"{a.out}/review", overwrite=a.overwrite, single=True)
    sinks.csv(report.top_matches(found, a.n, known).orderBy("rank"), f"{a.out}/top", overwrite=a.overwrite, single=True)
    save(report.flagged_conversations(found, known, a.cutoff), a, "conversations")


@command("windows", "nodes")
def cut_windows(spark: SparkSession, a: argparse.Namespace) -> None:
    save(chunks.windows(spark.read.parquet(a.nodes), "node_id", "embed_text", a.chunk_tokens, a.overlap), a)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakewarden", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, needed) in COMMANDS.items():
        sub = subs.add_parser(name)
        for option in (*needed, "out"):
            sub.add_argument(f"--{option}", required=True)
        sub.add_argument("--overwrite", action="store_true")
        for option, kind, value in (("seed", int, 42), ("k", int, 5), ("n", int, 100), ("top-k", int, 5), ("recall", float, 0.8), ("test-fraction", float, 0.3), ("min-frac", float, 0.5), ("cutoff", float, 0.5), ("chunk-tokens", int, 128), ("overlap", int, 16), ("model", str, "judge"), ("effort", str, "low"), ("mode", str, "contrast")):
            sub.add_argument(f"--{option}", type=kind, default=value)
        sub.add_argument("--thresholds", type=float, nargs="*", default=[0.4, 0.45, 0.5, 0.55])
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName(f"lakewarden {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[a.command][0](session, a)


if __name__ == "__main__":
    main()
