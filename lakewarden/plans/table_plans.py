"""Queries for samples, folds, contracts and judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.functions import text as T
from lakewarden.operators import contracts, judge, nodes, report, sampling
from lakewarden.sources.tables import table


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as severities: 0, or 3 to 5."""
    severity = F.when(F.col("toxic") == 0, "0").otherwise((F.col("doc_id") % 3 + 3).cast("string"))
    return table(spark, folder, "labels").select(F.concat(F.lit("post:"), "doc_id").alias("node_id"), severity.alias("severity"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.concat(F.lit("post:"), "doc_id").alias("node_id"), "doc_id", "text", "source", "lang")


JUDGED_SQL = """WITH j AS (SELECT 'post:' || doc_id AS node_id, CASE WHEN toxic = 0 THEN '0' ELSE (doc_id % 3 + 3)::VARCHAR END AS severity FROM labels),
x AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY sha256('42:' || node_id), node_id) AS p, count(*) OVER (PARTITION BY severity) AS c FROM j)
"""


def sample_simple(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.simple(documents(spark, folder).filter(T.strip(F.coalesce("text", F.lit(""))) != ""), "node_id", 100).select("node_id", "source")


def sample_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified(judged(spark, folder), "node_id", "severity", 12)


def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split(judged(spark, folder), "node_id", "severity", 0.3)


def folds_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.folds(judged(spark, folder), "node_id", "severity", 5)


def fold_coverage_check(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.fold_coverage(folds_stratified(spark, folder), 5, "5")


def set_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.set_fingerprint(split_stratified(spark, folder).filter("split = 'test'"), "node_id")


def one_to_one_join(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.one_to_one(judged(spark, folder), documents(spark, folder), "node_id").select("node_id", "severity", "source")


def one_to_one_report(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.one_to_one_report(documents(spark, folder), judged(spark, folder), "node_id")


def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).join(judged(spark, folder), "node_id", "left_semi").select("node_id", "lang")


def duplicate_texts(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.duplicates(documents(spark, folder).select(T.sha256(F.col("text")).alias("sha")), "sha")


def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.set_difference(documents(spark, folder), judged(spark, folder), "node_id")


def hash_verification(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("expected", F.when(F.col("lang") == "es", "wrong").otherwise(T.sha256(F.col("text"))))
    return contracts.hash_mismatches(docs, "text", "expected").select("node_id")


def text_equality_check(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    other = docs.withColumn("text", F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).filter("lang != 'fr'")
    return contracts.text_mismatches(docs, other, "node_id", "text")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).withColumns({"example_num": F.col("doc_id") + 1, "node_type": F.lit("post"), "title": F.when(F.col("doc_id") % 2 == 0, F.col("source")), "is_truncated": F.col("doc_id") % 5 == 0})


def anti_join_pending(spark: SparkSession, folder: str) -> DataFrame:
    return judge.pending(asked(spark, folder), judged(spark, folder), limit=150).select("node_id", "example_num")


def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = asked(spark, folder).withColumn("text", F.concat("text", F.lit(" </sample>")))
    return rows.select("node_id", T.sha256(judge.wrap(judge.render(rows))).alias("prompt_sha256"))


def request_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = asked(spark, folder)
    line = rows.select(judge.request_line(rows, "Judge this.", "judge-1", "low").alias("line"))
    return line.select(F.get_json_object("line", "$.custom_id").alias("node_id"), F.get_json_object("line", "$.body.model").alias("model"), F.get_json_object("line", "$.body.input[0].content").alias("prompt"), T.sha256(F.get_json_object("line", "$.body.input[1].content")).alias("content_sha256"))


def review_block(spark: SparkSession, folder: str) -> DataFrame:
    rows = asked(spark, folder).join(judged(spark, folder), "node_id", "left").withColumn("verdict", F.when(F.col("severity") == "0", "safe").when(F.col("severity").isNotNull(), "unsafe"))
    return rows.select("node_id", T.sha256(judge.review_block(rows)).alias("block_sha256"))


# Answers of a judge, with what their parts are by the rules.
ANSWERS = (
    ('{"verdict":"unsafe","severity":4,"risk_taxonomy_categories":["prompt_injection"," other ",""],"OWASP_risk_codes":["LLM01"],"harmful_intent":"x"}', ("unsafe", "4", "prompt_injection; other", "LLM01", "x")),
    ('Sure: {"verdict":"safe","severity":"3"} done', ("safe", "3", "", "", "")),
    ('[{"verdict":"safe"}]', ("unparseable", "", "", "", '[{"verdict":"safe"}]')),
    ('{"verdict": broken', ("unparseable", "", "", "", '{"verdict": broken')),
    ('{"label":"unsafe","severity":"3.0","risk_taxonomies":["other"]}', ("unsafe", "", "other", "", "")),
    ('{"verdict":null,"severity":3.7,"risk_taxonomy_categories":null,"risk_taxonomies":["other"],"harmful_intent":null}', ("None", "3", "", "", "None")),
    ('{"verdict":"safe","severity":true,"risk_taxonomy_categories":"other"}', ("safe", "1", "other", "", "")),
    ("", ("unparseable", "", "", "", "")),
)


def verdict_parse(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.array(*[F.lit(a) for a, _ in ANSWERS])
    rows = table(spark, folder, "events").select("event_id", F.get(texts, (F.col("event_id") % len(ANSWERS)).cast("int")).alias("content"))
    return rows.select("event_id", judge.parse_verdict(F.col("content")).alias("v")).select("event_id", "v.*")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def response_parse(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    message = F.struct(F.lit("message").alias("type"), F.array(part("output_text", F.col("event_type")), part("refusal", F.lit("no")), part("output_text", F.col("props"))).alias("content"))
    thought = F.struct(F.lit("reasoning").alias("type"), F.array(part("output_text", F.lit("hidden"))).alias("content"))
    usage = F.when(F.col("event_id") % 3 > 0, F.struct(F.col("event_id").alias("input_tokens"), F.struct((F.col("event_id") % 9).alias("cached_tokens")).alias("input_tokens_details")))
    body = F.struct(F.array(thought, message).alias("output"), usage.alias("usage"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response")))
    lines = table(spark, folder, "events").select(F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(line).alias("value"))
    return judge.parse_responses(lines).drop("line_error")


def reconcile_union(spark: SparkSession, folder: str) -> DataFrame:
    """Judged documents succeeded (toxic ones twice), German ones also have errors, the rest is missing."""
    docs, done = documents(spark, folder), judged(spark, folder)
    ok = done.select("node_id").unionByName(done.filter("severity != '0'").select("node_id"))
    return judge.reconcile(docs.select("node_id"), ok, docs.filter("lang = 'de'").select("node_id"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    rows = asked(spark, folder).join(judged(spark, folder), "node_id")
    return rows.select("example_num", "node_id", "node_type", F.when(F.col("doc_id") % 6 == 0, "error").when(F.col("severity") == "0", "safe").otherwise("unsafe").alias("verdict"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("severity")).alias("severity"))


RESULTS_SQL = """, r AS (SELECT d.doc_id + 1 AS example_num, j.node_id, 'post' AS node_type, CASE WHEN d.doc_id % 6 = 0 THEN 'error' WHEN severity = '0' THEN 'safe' ELSE 'unsafe' END AS verdict,
    CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE severity END AS severity FROM j JOIN documents d ON j.node_id = 'post:' || d.doc_id)
"""


def update_join_merge(spark: SparkSession, folder: str) -> DataFrame:
    base = _results(spark, folder)
    retry = base.filter("verdict = 'error' or severity = '3'").withColumns({"verdict": F.lit("retried"), "severity": F.lit(""), "example_num": F.lit(0).cast("long")})
    return judge.merge_retry(base, retry.select(*base.columns))


def retry_select(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder)
    source = asked(spark, folder).filter("lang != 'fr'").drop("is_truncated")
    return judge.retry_input(results.unionByName(results), source, ["error"]).select("example_num", "node_id", "is_truncated")


def reparse_overlay(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder).withColumns({c: F.lit("") for c in ("risk_taxonomies", "owasp_risk_codes", "harmful_intent")})
    texts = F.array(*[F.lit(a) for a, _ in ANSWERS])
    raw = results.filter("verdict != 'error'")
    raw = raw.select("node_id", "example_num", F.lit("old").alias("output_text")).unionByName(raw.select("node_id", (F.col("example_num") + 100_000).alias("example_num"), F.get(texts, (F.col("example_num") % len(ANSWERS)).cast("int")).alias("output_text")))
    return judge.reparse(results, raw)


def severity_normalize(spark: SparkSession, folder: str) -> DataFrame:
    spelled = F.when(F.col("event_id") % 4 == 0, "3.0").when(F.col("event_id") % 4 == 1, F.lit("")).when(F.col("event_id") % 4 == 2, " 5 ").otherwise("bad")
    return table(spark, folder, "events").select("event_id", judge.severity_text(spelled).alias("severity"))


def crosstab_fold_severity(spark: SparkSession, folder: str) -> DataFrame:
    wide = report.crosstab(folds_stratified(spark, folder), "fold", "severity", ["0", "3", "4", "5"])
    return wide.select("fold", *[F.col(f"`{s}`").alias(f"severity_{s}") for s in "0345"])


def value_counts_head(spark: SparkSession, folder: str) -> DataFrame:
    return report.value_counts(documents(spark, folder), "source", 10)


def node_result_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = asked(spark, folder).select("node_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("submolt_name"), F.when(F.col("doc_id") % 4 == 0, "bad").when(F.col("doc_id") % 4 == 1, F.col("doc_id").cast("string")).alias("score"), nodes.preview(F.col("text")).alias("text_preview"))
    return nodes.result_fields(rows)


def binary_labels(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).select("node_id", judge.binary_label(F.col("severity")).alias("label"))


def split_filter_fallback(spark: SparkSession, folder: str) -> DataFrame:
    parted = split_stratified(spark, folder)
    some = contracts.filter_or_all(parted, F.col("severity") == "5").withColumn("part", F.lit("severity 5"))
    none = contracts.filter_or_all(parted, F.col("severity") == "9").withColumn("part", F.lit("fallback"))
    return some.unionByName(none)


def verdict_tallies(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).groupBy("verdict").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("severity").try_cast("bigint")), F.lit(0)).alias("severity_sum"))


def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return seen.select("user_id", "first_event")


def model_input(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("node_id", T.sha256(T.model_input(F.col("text"), "Instruct: ")).alias("sha256"))


def approximate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).groupBy("source").agg(F.sum(T.approximate_tokens(F.col("text"))).alias("tokens"))


QUERIES = {f.__name__: f for f in (
    node_result_fields, binary_labels, split_filter_fallback, verdict_tallies, ordered_distinct, model_input, approximate_tokens, sample_simple, sample_stratified, split_stratified, folds_stratified, fold_coverage_check, set_fingerprint, one_to_one_join, one_to_one_report, semi_join, duplicate_texts, set_difference, hash_verification,
    text_equality_check, anti_join_pending, prompt_render, request_json, review_block, verdict_parse, response_parse, reconcile_union, update_join_merge, retry_select, reparse_overlay, severity_normalize, crosstab_fold_severity, value_counts_head,
)}

_FOLDS = JUDGED_SQL + ", f AS (SELECT node_id, severity, ((p - 1) % 5)::BIGINT AS fold FROM x)\n"
_ANSWER = lambda k, n: f"CASE {n} " + " ".join(f"WHEN {i} THEN {_quoted(p[k])}" for i, (_, p) in enumerate(ANSWERS)) + " END"
_PARTS = ("verdict", "severity", "risk_taxonomies", "owasp_risk_codes", "harmful_intent")
_RENDER = """'node_type: post' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'title: ' || source || chr(10) ELSE '' END || 'text:' || chr(10) || BODY || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '[note: this text was truncated during sampling]' ELSE '' END"""
_TRIM = r"regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"

ORACLES = {
    "node_result_fields": "SELECT 'post:' || doc_id AS node_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS submolt_name, CASE WHEN doc_id % 4 = 1 THEN doc_id ELSE 0 END AS score, left(coalesce(text, ''), 200) AS text_preview FROM documents",
    "binary_labels": "SELECT 'post:' || doc_id AS node_id, (toxic = 1)::BIGINT AS label FROM labels",
    "split_filter_fallback": JUDGED_SQL + ", w AS (SELECT node_id, severity, CASE WHEN p <= round_even(c * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM x) SELECT *, 'severity 5' AS part FROM w WHERE severity = '5' UNION ALL SELECT *, 'fallback' FROM w",
    "verdict_tallies": JUDGED_SQL + RESULTS_SQL + "SELECT verdict, count(*) AS n, coalesce(sum(try_cast(severity AS BIGINT)), 0)::BIGINT AS severity_sum FROM r GROUP BY verdict",
    "ordered_distinct": "SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id",
    "model_input": r"SELECT 'post:' || doc_id AS node_id, sha256('Instruct: ' || regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '@', 'g')) AS sha256 FROM documents",
    "approximate_tokens": "SELECT source, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY source",
    "sample_simple": r"SELECT 'post:' || doc_id AS node_id, source FROM documents WHERE regexp_matches(coalesce(text, ''), '\S') ORDER BY sha256('42:post:' || doc_id), 'post:' || doc_id LIMIT 100",
    "sample_stratified": JUDGED_SQL + "SELECT node_id, severity FROM x WHERE p <= 12",
    "split_stratified": JUDGED_SQL + "SELECT node_id, severity, CASE WHEN p <= round_even(c * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM x",
    "folds_stratified": _FOLDS + "SELECT * FROM f",
    "fold_coverage_check": _FOLDS + "SELECT fold, count(*) AS n, count(*) FILTER (WHERE severity = '5') AS n_required, count(*) > 0 AND count(*) FILTER (WHERE severity = '5') > 0 AS ok FROM f GROUP BY fold",
    "set_fingerprint": JUDGED_SQL + "SELECT sha256(string_agg(node_id, chr(10) ORDER BY node_id)) AS fingerprint, count(*) AS n FROM x WHERE p <= round_even(c * 0.3::DOUBLE, 0)",
    "one_to_one_join": JUDGED_SQL + "SELECT j.node_id, severity, source FROM j JOIN documents d ON j.node_id = 'post:' || d.doc_id",
    "one_to_one_report": JUDGED_SQL + "SELECT *, n_left_repeated = 0 AND n_right_repeated = 0 AND n_unmatched = 0 AS ok FROM (SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS n_left_repeated, (SELECT count(*) - count(DISTINCT node_id) FROM j) AS n_right_repeated, (SELECT count(*) FROM documents WHERE 'post:' || doc_id NOT IN (SELECT node_id FROM j)) AS n_unmatched)",
    "semi_join": "SELECT 'post:' || doc_id AS node_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "duplicate_texts": "SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "set_difference": JUDGED_SQL + ", d AS (SELECT 'post:' || doc_id AS node_id FROM documents) SELECT count(*) FILTER (WHERE j.node_id IS NULL) AS n_left_only, count(*) FILTER (WHERE d.node_id IS NULL) AS n_right_only, count(*) FILTER (WHERE d.node_id = j.node_id) AS n_both FROM d FULL JOIN j ON d.node_id = j.node_id",
    "hash_verification": "SELECT 'post:' || doc_id AS node_id FROM documents WHERE lang = 'es'",
    "text_equality_check": "SELECT 'post:' || doc_id AS node_id FROM documents WHERE text IS NOT NULL AND (lang = 'es' OR (lang = 'fr' OR lang IS NULL) AND text != '')",
    "anti_join_pending": "SELECT 'post:' || doc_id AS node_id, doc_id + 1 AS example_num FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 150",
    "prompt_render": "SELECT 'post:' || doc_id AS node_id, sha256('<sample>' || chr(10) || replace(" + _RENDER.replace("BODY", _TRIM.replace("text,", "text || ' </sample>',")) + ", '</sample>', '<⁄sample>') || chr(10) || '</sample>') AS prompt_sha256 FROM documents",
    "request_json": "SELECT 'post:' || doc_id AS node_id, 'judge-1' AS model, 'Judge this.' AS prompt, sha256('<sample>' || chr(10) || replace(" + _RENDER.replace("BODY", _TRIM) + ", '</sample>', '<⁄sample>') || chr(10) || '</sample>') AS content_sha256 FROM documents",
    "review_block": JUDGED_SQL + """SELECT 'post:' || d.doc_id AS node_id, sha256('example_num: ' || (d.doc_id + 1) || chr(10) || 'node_id:     post:' || d.doc_id || chr(10) || 'node_type:   post' || chr(10) ||
        'verdict:     ' || coalesce(CASE WHEN severity = '0' THEN 'safe' WHEN severity IS NOT NULL THEN 'unsafe' END, '') || '  |  severity: ' || coalesce(severity, '') || chr(10) || 'risk_taxonomies: ' || chr(10) || 'owasp_risk_codes: ' || chr(10) || 'harmful_intent:  ' || chr(10) ||
        CASE WHEN d.doc_id % 2 = 0 THEN 'title: ' || source || chr(10) ELSE '' END || chr(10) || coalesce(text, '')) AS block_sha256 FROM documents d LEFT JOIN j ON j.node_id = 'post:' || d.doc_id""",
    "verdict_parse": "SELECT event_id, " + ", ".join(f"{_ANSWER(k, f'event_id % {len(ANSWERS)}')} AS {c}" for k, c in enumerate(_PARTS)) + " FROM events",
    "response_parse": "SELECT event_id::VARCHAR AS node_id, 200 AS status_code, event_type || props AS output_text, CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR ELSE '' END AS input_tokens, '' AS output_tokens, CASE WHEN event_id % 3 > 0 THEN (event_id % 9)::VARCHAR ELSE '' END AS cached_tokens, '' AS reasoning_tokens FROM events WHERE event_type != 'error'",
    "reconcile_union": JUDGED_SQL + "SELECT node_id, 'success' AS outcome FROM j UNION ALL SELECT node_id, 'success' FROM j WHERE severity != '0' UNION ALL SELECT 'post:' || doc_id, CASE WHEN lang = 'de' THEN 'error' ELSE 'missing' END FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "update_join_merge": JUDGED_SQL + RESULTS_SQL + "SELECT example_num, node_id, node_type, CASE WHEN verdict = 'error' OR severity = '3' THEN 'retried' ELSE verdict END AS verdict, CASE WHEN verdict = 'error' OR severity = '3' THEN '' ELSE severity END AS severity FROM r",
    "retry_select": JUDGED_SQL + RESULTS_SQL + "SELECT row_number() OVER (ORDER BY example_num) AS example_num, node_id, false AS is_truncated FROM r JOIN documents d ON r.example_num = d.doc_id + 1 WHERE verdict = 'error' AND lang != 'fr'",
    "reparse_overlay": JUDGED_SQL + RESULTS_SQL + "SELECT example_num, node_id, node_type, " + ", ".join(f"CASE WHEN verdict != 'error' THEN {_ANSWER(k, f'example_num % {len(ANSWERS)}')} ELSE {c if k < 2 else _quoted('')} END AS {c}" for k, c in enumerate(_PARTS)) + " FROM r",
    "severity_normalize": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '3' WHEN 2 THEN '5' ELSE '' END AS severity FROM events",
    "crosstab_fold_severity": _FOLDS + "SELECT fold, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS severity_{s}" for s in "0345") + " FROM f GROUP BY fold",
    "value_counts_head": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10",
}
