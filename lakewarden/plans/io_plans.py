"""Queries that write to the shared folder and read back, and queries for contracts, batches and configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.functions import text as T
from lakewarden.operators import chunks, contracts, judge, models, nodes, report, sampling
from lakewarden.plans.table_plans import JUDGED_SQL, asked, documents, judged
from lakewarden.sources import config, published, readers, sinks
from lakewarden.sources.staging import new_path, stage_dealt
from lakewarden.sources.tables import table
from lakewarden.streaming import judge_loop


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, commas and line breaks, nulls and blanks, through CSV and back as text."""
    path = new_path(spark, "csv")
    awkward = F.concat(F.lit(' "a",\n'), F.coalesce("text", F.lit("")), F.lit("\\ ''\n"))
    rows = table(spark, folder, "documents").select("doc_id", awkward.alias("text"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"), F.lit("  ").alias("blank"), "lang")
    sinks.csv(rows, path, ["doc_id", "text", "source", "blank"])
    return readers.csv_text(spark, path).select(F.col("doc_id").cast("long"), T.sha256(F.col("text")).alias("sha256"), "source", "blank")


def csv_typed(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "csv")
    sinks.csv(table(spark, folder, "events").select("event_id", "event_type", "value"), path)
    return readers.csv_typed(spark, path, "event_id long, event_type string, value double", ["event_id", "value"])


def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Objects one a line; blank lines among them are skipped."""
    path = new_path(spark, "jsonl")
    rows = table(spark, folder, "events").select("event_id", "event_type", "props")
    line = F.when(F.col("event_id") % 7 == 0, F.lit(" \t")).otherwise(F.to_json(F.struct("event_id", "event_type", "props")))
    sinks.json_lines(rows.select(line.alias("value")), path)
    return readers.json_lines(spark, path, "event_id long, event_type string, props string")


def request_file(spark: SparkSession, folder: str) -> DataFrame:
    """Request lines written as a file and read back."""
    rows, path = asked(spark, folder), new_path(spark, "requests")
    sinks.json_lines(rows.select(judge.request_line(rows, "Judge this.", "judge-1", "low").alias("value")), path)
    found = readers.json_lines(spark, path, "custom_id string, method string, url string, body struct<model: string, reasoning: struct<effort: string>, max_output_tokens: int>")
    return found.select("custom_id", "method", "url", "body.model", "body.reasoning.effort", "body.max_output_tokens")


def id_list_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids as lines, and as a table with their hashes."""
    lines, rows = new_path(spark, "ids"), new_path(spark, "id-table")
    docs = documents(spark, folder)
    sinks.id_list(docs.filter("doc_id % 2 = 0").unionByName(docs.limit(0)), lines)
    sinks.csv(docs.filter("doc_id % 2 = 1").select("node_id", T.sha256(F.coalesce("text", F.lit(""))).alias("text_sha256")), rows)
    return readers.id_list(spark, lines).withColumn("text_sha256", F.lit("")).unionByName(readers.id_table(spark, rows))


def parquet_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """A second write is refused, then takes the first one's place; optional columns are read where they exist."""
    path = new_path(spark, "parquet")
    docs = table(spark, folder, "documents")
    sinks.parquet(docs.limit(1), path)
    try:
        sinks.parquet(docs, path)
        refused = False
    except Exception:
        refused = True
    sinks.parquet(docs.drop("n_chars"), path, overwrite=True)
    return readers.parquet(spark, path, ["doc_id"], ["lang", "n_chars"]).withColumn("refused", F.lit(refused))


def append_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Results appended in two batches, as Parquet and as CSV; what is left to do."""
    path, csv = new_path(spark, "results"), new_path(spark, "results-csv")
    rows = asked(spark, folder).select("node_id", "example_num")
    schema = "node_id string, example_num long"
    left = []
    for part in (0, 1):
        done = readers.if_exists(spark, path, schema)
        fresh = judge.pending(rows, done).filter(F.col("example_num") % 3 == part)
        left.append(fresh.count())
        sinks.append_rows(fresh, path)
        sinks.append_rows(fresh, csv, "csv")
    done = readers.if_exists(spark, path, schema).join(readers.csv_text(spark, csv).select("node_id"), "node_id", "left_semi")
    return judge.pending(rows, done, limit=200).withColumns({"first": F.lit(left[0]).cast("long"), "second": F.lit(left[1]).cast("long")})


def severity_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered blocks and rows by severity, read back from their folders."""
    path = new_path(spark, "severity")
    rows = judged(spark, folder).withColumn("block", F.concat(F.lit("node "), "node_id"))
    sinks.by_severity(rows, path, "block")
    blocks = spark.read.text(f"{path}/text").groupBy(F.col("severity").cast("string").alias("severity")).agg(F.count("*").alias("n_blocks"), F.min("value").alias("first_block"))
    cells = spark.read.option("header", True).csv(f"{path}/csv").groupBy(F.col("severity").cast("string").alias("severity")).agg(F.count("*").alias("n_rows"), F.max("node_id").alias("last_node"))
    return blocks.join(cells, "severity")


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of a table is that of its copy in other files and another order, and not that of one with a changed row."""
    docs = table(spark, folder, "documents")
    copy = stage_dealt(docs, "copy", "doc_id")
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    own, again, other = (contracts.content_hash(x).select(F.col("n_rows"), F.col("hash_sum").alias(f"h{k}")) for k, x in enumerate((docs, copy, changed)))
    return own.crossJoin(again.select("h1")).crossJoin(other.select("h2")).select("n_rows", (F.col("h0") == F.col("h1")).alias("same"), (F.col("h0") != F.col("h2")).alias("differs"))


def manifest_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A run's manifest merged into the one before it, flattened."""
    labels = table(spark, folder, "labels")
    run = sinks.manifest(spark, {"labels": labels}, {"k": 5, "paths": {"out": "b"}}, {"scan": 1.5})
    merged = sinks.merge_manifest({"config": {"k": 3, "seed": 42, "paths": {"in": "a"}}, "note": "first"}, run)
    merged = json.loads(sinks.manifest_text(merged))
    told = all(merged["environment"][x] for x in ("spark", "java", "python"))
    row = {"k": merged["config"]["k"], "seed": merged["config"]["seed"], "paths": json.dumps(merged["config"]["paths"], sort_keys=True), "note": merged["note"], "n_rows": merged["inputs"]["labels"]["n_rows"], "scan": merged["timings"]["scan"], "environment": told}
    return spark.createDataFrame([tuple(row.values())], "k long, seed long, paths string, note string, n_rows long, scan double, environment boolean")


def revision_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A known and an unknown revision, and a local file that wins."""
    mirror = new_path(spark, "mirror")
    spark.createDataFrame([("0123abcd",)], "value string").coalesce(1).write.text(f"{mirror}/refs/main")
    found = [published.resolve_revision(spark, mirror, "main"), published.resolve_revision(spark, mirror, "v9"), published.locate(spark, mirror, "main", "nodes.csv")["path"].removeprefix(mirror), published.locate(spark, mirror, "main", "nodes.csv", "/own.csv")["source_type"]]
    return spark.createDataFrame([(k, v) for k, v in enumerate(found)], "place long, value string")


def sync_published(spark: SparkSession, folder: str) -> DataFrame:
    """Published ids with hashes against the corpus, with the severities of the verdicts."""
    corpus = asked(spark, folder).select("node_id", "node_type", "title", "text").filter(F.coalesce("title", "text", F.lit("")) != "")
    text = T.compose(F.col("node_type"), F.col("title"), F.col("text"))
    ids = corpus.filter("node_id like '%3'").select("node_id", T.sha256(text).alias("text_sha256"))
    found = published.with_severity(published.sync_nodes(ids, corpus), judged(spark, folder))
    return found.select("node_id", "severity", T.sha256(F.col("embed_text")).alias("sha256"))


def sync_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """How many listed nodes each contract of the sync refuses."""
    corpus = asked(spark, folder).select("node_id", "node_type", "title", "text")
    ids = corpus.select("node_id").limit(3)
    cases = {
        "missing": (ids.unionByName(spark.createDataFrame([("post:none",)], "node_id string")), corpus), "hash": (ids.withColumn("text_sha256", F.lit("0")), corpus), "type": (ids, corpus.withColumn("node_type", F.lit("page"))), "none": (ids, corpus),
    }
    found = []
    for name, (listed, known) in cases.items():
        try:
            published.sync_nodes(listed, known).count()
            found.append((name, False))
        except contracts.ContractError:
            found.append((name, True))
    return spark.createDataFrame(found, "contract string, refused boolean")


def checkpoint_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints among file names in numeric order; the last one is picked."""
    names = table(spark, folder, "events").select(F.concat(F.lit("run/head_epoch"), "event_id", F.when(F.col("event_id") % 3 == 0, ".tmp").otherwise(".pt")).alias("path")).distinct()
    found = readers.checkpoints(names)
    last = readers.last_checkpoint(found).select(F.col("epoch").alias("last_epoch"))
    return found.crossJoin(F.broadcast(last)).withColumn("picked", F.col("epoch") == F.col("last_epoch")).drop("last_epoch")


def cut_text(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents(spark, folder).select("node_id", T.sha256(T.cut(text, 100)).alias("cut_sha256"), (T.cut(text, 0) == text).alias("whole"))


def whole_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Chunking off: one pseudo window a document."""
    return chunks.whole(table(spark, folder, "documents"), "doc_id", "text").withColumn("text", T.sha256(F.col("text")))


def present_columns(spark: SparkSession, folder: str) -> DataFrame:
    return nodes.present(table(spark, folder, "documents"), ["doc_id", "submolt_name", "source", "score", "lang"])


def schema_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Expected columns in order; a missing one and a repeated one are refused."""
    docs, refused = table(spark, folder, "documents"), []
    for names in (["doc_id", "none"], ["doc_id", "doc_id"]):
        try:
            contracts.require_columns(docs, names)
        except contracts.ContractError:
            refused.append(names)
    return contracts.require_columns(docs, ["source", "doc_id"]).withColumn("refused", F.lit(len(refused)))


def missing_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """How many scored nodes are left out for want of a conversation."""
    scored = asked(spark, folder).select("node_id")
    known = asked(spark, folder).select("node_id", F.when(F.col("lang") != "de", F.col("source")).alias("conversation_id"))
    return report.without_conversation(scored, known)


def fold_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """The stored assignment is used again where it equals the fresh one; another one is refused, or replaced if told."""
    fresh = sampling.folds(judged(spark, folder), "node_id", "severity", 5)
    stored = stage_dealt(fresh, "folds", "node_id")
    other = stored.withColumn("fold", F.lit(0).cast("long"))
    try:
        sampling.reconcile(fresh, other)
        refused = False
    except ValueError:
        refused = True
    kept = sampling.reconcile(fresh, stored).withColumn("source", F.lit("stored"))
    replaced = sampling.reconcile(fresh, other, overwrite=True).withColumn("source", F.lit("fresh"))
    return kept.unionByName(replaced).groupBy("source", "fold").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


def severity_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Assigned severities against the verdicts: equal ones pass, changed ones are refused."""
    rows, refused = judged(spark, folder), False
    assigned = sampling.folds(published.same_severity(rows, rows), "node_id", "severity", 5)
    try:
        published.same_severity(rows.withColumn("severity", F.lit("4")), rows)
    except contracts.ContractError:
        refused = True
    return assigned.groupBy("severity").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


def probability_check(spark: SparkSession, folder: str) -> DataFrame:
    p = lambda c: c.cast("double").alias("p")
    rows = table(spark, folder, "embeddings")
    cases = {"good": rows.select(p(F.col("vec_id") % 10 / 9)), "high": rows.select(p(F.col("vec_id") % 10 / 8)), "nan": rows.select(p(F.when(F.col("vec_id") == 3, float("nan")).otherwise(0.5))), "null": rows.select(p(F.nullif(F.col("vec_id"), F.lit(1)) * 0)), "empty": rows.limit(0).select(p(F.lit(0)))}
    parts = [df.agg(contracts.probabilities_ok(df, "p").alias("ok")).withColumn("name", F.lit(name)) for name, df in cases.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Labels of a judge with what breaks the domain.
LABELS = (
    ("prompt_injection; other", "LLM01", "3", "other_with_more"), ("jailbreak_or_safety_bypass", "LLM10; LLM02", "0", ""), ("made_up", "LLM11", "6", "taxonomy,owasp,severity"),
    ("prompt_injection; jailbreak_or_safety_bypass; engagement_manipulation; financial_scams_or_fraud", "LLM01; LLM02; LLM03; LLM04", "5", "many_taxonomies,many_codes"), ("", "", "", "severity"),
)


def label_domain(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in LABELS]), (F.col("event_id") % len(LABELS)).cast("int"))
    return table(spark, folder, "events").select("event_id", F.array_join(judge.label_faults(pick(0), pick(1), pick(2)), ",").alias("faults"))


def option_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Options between commas, stripped, blanks dropped."""
    given = F.concat_ws(",", F.lit(" "), "event_type", F.concat(F.lit("\t"), "user_id", F.lit(" ")), F.lit(""))
    return table(spark, folder, "events").select("event_id", F.array_join(T.option_list(F.when(F.col("event_id") % 5 > 0, given)), "|").alias("options"))


def fetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every asked document of a batch: successes, failed lines of the output file, lines of the error file, and missing ones."""
    docs = documents(spark, folder)
    status = F.when(F.col("doc_id") % 5 == 1, 500).otherwise(200)
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), F.col("lang").alias("text"))).alias("content"))).alias("output"))
    line = F.to_json(F.struct(F.col("node_id").alias("custom_id"), F.struct(status.alias("status_code"), body.alias("body")).alias("response")))
    failed = F.to_json(F.struct(F.col("node_id").alias("custom_id"), F.lit("expired").alias("error")))
    paths = new_path(spark, "output"), new_path(spark, "errors")
    sinks.json_lines(docs.filter("doc_id % 5 < 3").select(line.alias("value")), paths[0])
    sinks.json_lines(docs.filter("doc_id % 5 in (2, 3)").select(failed.alias("value")), paths[1])
    output, errors = (judge.parse_responses(spark.read.text(p)) for p in paths)
    return judge.outcomes(docs, output, errors).select("node_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


def config_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Drift in reported fields is told, in others refused; a configuration's paths and options."""
    base = {"model": "a", "dim": 384, "batch_size": 8, "device": "cpu"}
    drift = models.check_contract(base | {"batch_size": 16}, base)
    try:
        models.check_contract(base | {"dim": 768}, base)
        refused = "no"
    except ValueError:
        refused = "yes"
    catalogue = {"data": {"nodes": "nodes.parquet", "remote": "file:///x"}}
    rows = [("drift", ",".join(drift)), ("refused", refused), ("path", config.path_of(catalogue, "data.nodes", "/base")), ("address", config.path_of(catalogue, "data.remote", "/base")), ("options", " ".join(config.arguments({"top_k": 3, "overwrite": True, "thresholds": [0.1, 0.2], "seed": None}, ["top-k", "overwrite", "thresholds", "seed"])))]
    return spark.createDataFrame(rows, "name string, value string")


def config_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations run in order of name until one fails; each run is measured."""
    docs, found = table(spark, folder, "documents"), []

    def run(name: str, settings: dict) -> None:
        if settings["chunk"] < 0:
            raise ValueError(name)
        cut = chunks.windows(docs, "doc_id", "text", settings["chunk"], 0)
        ticks = iter((0.0, 2.0))
        found.append((name, cut.count(), models.timed(docs.select("doc_id"), 100, lambda: next(ticks))["nodes_per_second"]))

    try:
        models.sweep({"c_bad": {"chunk": -1}, "b_long": {"chunk": 64}, "a_short": {"chunk": 32}, "d_never": {"chunk": 8}}, run)
        stopped = False
    except ValueError:
        stopped = True
    return spark.createDataFrame([(*row, stopped) for row in found], "name string, n_windows long, rate double, stopped boolean")


def judge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The judging loop as a stream over asked files: run, run again with more rows, each row judged once."""
    base = new_path(spark, "stream")
    rows = asked(spark, folder).select("node_id", "example_num", "text")
    verdict = lambda df: df.select("node_id", F.when(F.char_length(F.coalesce("text", F.lit(""))) % 2 == 0, "safe").otherwise("unsafe").alias("verdict"))
    for part in (0, 1):
        rows.filter((F.col("example_num") % 2 == part) | (F.col("example_num") % 10 == 0)).write.mode("append").parquet(f"{base}/asked")
        judge_loop.run(spark, f"{base}/asked", "node_id string, example_num long, text string", f"{base}/results", "node_id string, verdict string", f"{base}/progress", verdict).awaitTermination()
    return readers.if_exists(spark, f"{base}/results", "node_id string, verdict string, batch long").select("node_id", "verdict")


def prompt_file(spark: SparkSession, folder: str) -> DataFrame:
    """A prompt's text is stripped; an empty one is refused."""
    path = new_path(spark, "prompt")
    spark.createDataFrame([("  Judge this. ",)], "value string").coalesce(1).write.text(path)
    text = readers.prompt("\n".join(r.value for r in spark.read.text(path).collect()))
    try:
        readers.prompt(" \n")
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(text, refused)], "prompt string, refused boolean")


QUERIES = {f.__name__: f for f in (
    csv_roundtrip, csv_typed, jsonl_roundtrip, request_file, id_list_roundtrip, parquet_overwrite, append_resume, severity_partitions, content_hash, manifest_merge, revision_lookup, sync_published, sync_refusals, checkpoint_pick,
    cut_text, whole_windows, present_columns, schema_projection, missing_conversations, fold_reconcile, severity_consistency, probability_check, label_domain, option_lists, fetch_outcomes, config_contract, config_sweep, judge_stream, prompt_file,
)}

_FAULTS = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN '{x[3]}'" for k, x in enumerate(LABELS)) + " END"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
_ASKED = "SELECT 'post:' || doc_id AS node_id, doc_id + 1 AS example_num FROM documents"

ORACLES = {
    "csv_roundtrip": "SELECT doc_id, sha256(' \"a\",' || chr(10) || coalesce(text, '') || '\\ ''''' || chr(10)) AS sha256, CASE WHEN doc_id % 3 > 0 THEN coalesce(source, '') ELSE '' END AS source, '  ' AS blank FROM documents",
    "csv_typed": "SELECT event_id, value FROM events",
    "jsonl_roundtrip": "SELECT event_id, event_type, props FROM events WHERE event_id % 7 != 0",
    "request_file": "SELECT 'post:' || doc_id AS custom_id, 'POST' AS method, '/v1/responses' AS url, 'judge-1' AS model, 'low' AS effort, 4096 AS max_output_tokens FROM documents",
    "id_list_roundtrip": "SELECT 'post:' || doc_id AS node_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE sha256(coalesce(text, '')) END AS text_sha256 FROM documents",
    "parquet_overwrite": "SELECT doc_id, lang, true AS refused FROM documents",
    "append_resume": f"SELECT *, (SELECT count(*) FROM ({_ASKED}) WHERE example_num % 3 = 0) AS first, (SELECT count(*) FROM ({_ASKED}) WHERE example_num % 3 = 1) AS second FROM ({_ASKED}) WHERE example_num % 3 = 2 ORDER BY example_num LIMIT 200",
    "severity_partitions": JUDGED_SQL + "SELECT severity, count(*) AS n_blocks, 'node ' || min(node_id) AS first_block, count(*) AS n_rows, max(node_id) AS last_node FROM j GROUP BY severity",
    "content_hash": "SELECT count(*) AS n_rows, true AS same, true AS differs FROM documents",
    "manifest_merge": """SELECT 5::BIGINT AS k, 42::BIGINT AS seed, '{"in": "a", "out": "b"}' AS paths, 'first' AS note, (SELECT count(*) FROM labels) AS n_rows, 1.5::DOUBLE AS scan, true AS environment""",
    "revision_lookup": "SELECT * FROM (VALUES (0::BIGINT, '0123abcd'), (1, 'v9'), (2, '/snapshots/0123abcd/nodes.csv'), (3, 'local_file')) AS t(place, value)",
    "sync_published": JUDGED_SQL + """SELECT 'post:' || doc_id AS node_id, coalesce(severity, '') AS severity, sha256(concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 0 THEN nullif(source, '') END, nullif(text, ''))) AS sha256
        FROM documents d LEFT JOIN j ON j.node_id = 'post:' || d.doc_id WHERE doc_id % 10 = 3 AND coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, text, '') != ''""",
    "sync_refusals": "SELECT * FROM (VALUES ('missing', true), ('hash', true), ('type', true), ('none', false)) AS t(contract, refused)",
    "checkpoint_pick": "SELECT event_id AS epoch, 'run/head_epoch' || event_id || '.pt' AS path, event_id = max(event_id) OVER () AS picked FROM events WHERE event_id % 3 != 0",
    "cut_text": "SELECT 'post:' || doc_id AS node_id, sha256(left(coalesce(text, ''), 100)) AS cut_sha256, true AS whole FROM documents",
    "whole_windows": "SELECT doc_id, 0::BIGINT AS chunk_index, 0::BIGINT AS start_token, 0::BIGINT AS end_token, sha256(coalesce(text, '')) AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents",
    "present_columns": "SELECT doc_id, source, lang FROM documents",
    "schema_projection": "SELECT source, doc_id, 2 AS refused FROM documents",
    "missing_conversations": "SELECT count(*) AS n_missing FROM documents WHERE NOT (coalesce(lang != 'de', false) AND source IS NOT NULL)",
    "fold_reconcile": JUDGED_SQL + ", f AS (SELECT ((p - 1) % 5)::BIGINT AS fold, count(*) AS n FROM x GROUP BY 1) SELECT source, fold, n, true AS refused FROM f, (VALUES ('stored'), ('fresh')) AS s(source)",
    "severity_consistency": JUDGED_SQL + "SELECT severity, count(*) AS n, true AS refused FROM j GROUP BY severity",
    "probability_check": "SELECT * FROM (VALUES ('good', true), ('high', false), ('nan', false), ('null', false), ('empty', false)) AS t(name, ok)",
    "label_domain": f"SELECT event_id, {_FAULTS} AS faults FROM events",
    "option_lists": "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN concat_ws('|', nullif(trim(event_type), ''), user_id::VARCHAR) ELSE '' END AS options FROM events",
    "fetch_outcomes": "SELECT 'post:' || doc_id AS node_id, CASE WHEN doc_id % 5 IN (0, 2) THEN 'success' WHEN doc_id % 5 IN (1, 3) THEN 'error' ELSE 'missing' END AS outcome, CASE doc_id % 5 WHEN 1 THEN 'status 500' WHEN 3 THEN 'expired' ELSE '' END AS reason FROM documents",
    "config_contract": "SELECT * FROM (VALUES ('drift', 'batch_size'), ('refused', 'yes'), ('path', '/base/nodes.parquet'), ('address', 'file:///x'), ('options', '--top-k 3 --overwrite --thresholds 0.1 0.2')) AS t(name, value)",
    "config_sweep": f"SELECT name, (SELECT sum(greatest(1, ceil({_WORDS} / size)))::BIGINT FROM documents) AS n_windows, 50.0::DOUBLE AS rate, true AS stopped FROM (VALUES ('a_short', 32), ('b_long', 64)) AS c(name, size)",
    "judge_stream": "SELECT 'post:' || doc_id AS node_id, CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 'safe' ELSE 'unsafe' END AS verdict FROM documents",
    "prompt_file": "SELECT 'Judge this.' AS prompt, true AS refused",
}
