"""The command line end to end on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lakewarden import cli
from lakewarden.sources import readers, sinks


def test_corpus_to_report(spark, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"
    run = lambda *argv: cli.main(list(argv), spark)
    spark.createDataFrame([(str(i), f"title {i}", f"text {i % 9}", i) for i in range(30)], "id string, title string, text string, score int").write.parquet(at("posts"))
    spark.createDataFrame([(f"c{i}", f"reply {i}", str(i % 5)) for i in range(40)], "id string, text string, post_id string").write.parquet(at("comments"))
    run("prep-data", "--posts", at("posts"), "--comments", at("comments"), "--out", at("nodes"))
    known = spark.read.parquet(at("nodes"))
    assert known.count() == 70
    with pytest.raises(Exception):
        run("prep-data", "--posts", at("posts"), "--comments", at("comments"), "--out", at("nodes"))
    run("windows", "--nodes", at("nodes"), "--out", at("windows"))
    spark.read.parquet(at("windows")).join(known.select("node_id", "node_type"), "node_id").withColumn("language", F.lit("en")).write.parquet(at("chunks"))
    run("language-filter", "--nodes", at("nodes"), "--chunks", at("chunks"), "--out", at("lang"))
    assert spark.read.parquet(at("lang/english")).count() == 70
    run("judge-sample", "--nodes", at("nodes"), "--n", "20", "--out", at("sample"))
    asked = readers.csv_text(spark, at("sample"))
    assert sorted(int(r.example_num) for r in asked.collect()) == list(range(1, 21))
    spark.createDataFrame([("Judge this.",)], "value string").coalesce(1).write.text(at("prompt"))
    run("judge-requests", "--input", at("sample"), "--prompt", at("prompt"), "--out", at("requests"))
    lines = [json.loads(r.value) for r in spark.read.text(at("requests")).collect()]
    assert len(lines) == 20 and lines[0]["body"]["input"][0]["content"] == "Judge this."
    verdict = lambda k: json.dumps({"verdict": "unsafe" if k % 2 else "safe", "severity": 3 if k % 2 else 0})
    answer = [json.dumps({"custom_id": x["custom_id"], "response": {"status_code": 200, "body": {"output": [{"type": "message", "content": [{"type": "output_text", "text": verdict(k)}]}]}}}) for k, x in enumerate(lines[:-1])]
    spark.createDataFrame([(x,) for x in answer], "value string").write.text(at("responses"))
    run("judge-fetch", "--input", at("sample"), "--responses", at("responses"), "--out", at("results"))
    results = readers.csv_text(spark, at("results"))
    assert {r.verdict: r["count"] for r in results.groupBy("verdict").count().collect()} == {"safe": 10, "unsafe": 9, "error": 1}
    sinks.csv(results.filter("verdict = 'error'").withColumns({"verdict": F.lit("safe"), "severity": F.lit("0")}), at("retry"))
    run("judge-merge", "--base", at("results"), "--retry", at("retry"), "--out", at("merged"))
    run("prepare-folds", "--verdicts", at("merged"), "--k", "2", "--out", at("split"))
    assert spark.read.parquet(at("split/folds")).count() + spark.read.parquet(at("split/test")).count() == 20
    sinks.id_list(spark.read.parquet(at("split/folds")), at("ids"))
    run("sync-nodes", "--nodes", at("nodes"), "--ids", at("ids"), "--out", at("synced"))
    severity = readers.csv_text(spark, at("merged")).select("node_id", "severity")
    cells = F.array(F.when(F.col("severity") == "3", 1.0).otherwise(0.2), F.lit(1.0) - F.length("node_id") / 100).cast("array<float>")
    severity.withColumn("vector", cells).drop("severity").write.parquet(at("vectors"))
    for command in ("eval-contrast", "eval-head"):
        run(command, "--vectors", at("vectors"), "--folds", at("split/folds"), "--k", "2", "--out", at(command))
        out = {r.fold: r for r in spark.read.parquet(at(command)).collect()}
        assert set(out) == {"0", "1", "mean", "std"} and out["mean"].recall >= 0.8
    severity.withColumn("vector", cells).withColumn("threat_id", F.concat(F.lit("seed:"), "node_id")).write.parquet(at("dictionary"))
    spark.read.parquet(at("windows")).join(spark.read.parquet(at("vectors")), "node_id").write.parquet(at("chunkvec"))
    for mode in ("contrast", "cluster", "example"):
        run("build-index", "--vectors", at("dictionary"), "--mode", mode, "--k", "3", "--out", at(f"index-{mode}"))
        run("scan", "--windows", at("chunkvec"), "--nodes", at("nodes"), "--index", at(f"index-{mode}"), "--mode", mode, "--top-k", "2", "--out", at(f"scan-{mode}"))
        assert spark.read.parquet(at(f"scan-{mode}")).count() == 20
    run("report", "--scan", at("scan-example"), "--nodes", at("nodes"), "--n", "5", "--out", at("report"))
    assert readers.csv_text(spark, at("report/thresholds")).count() == 4
