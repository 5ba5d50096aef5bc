"""Judging, contracts, vectors, reports, readers and the incremental loop."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import contracts, judge, models, report, vectors as V
from lakewarden.sources import readers, sinks, staging
from lakewarden.streaming import judge_loop


@pytest.mark.parametrize("text, want", [
    ('{"verdict":"safe","severity":0}', ("safe", "0", "", "", "")),
    ('x {"verdict":"unsafe","severity":"4","risk_taxonomy_categories":["a"," b ",""]} y', ("unsafe", "4", "a; b", "", "")),
    ("[1]", ("unparseable", "", "", "", "[1]")), ("{oops", ("unparseable", "", "", "", "{oops")), (None, ("unparseable", "", "", "", "")),
    ('{"label":"safe","severity":"3.0"}', ("safe", "", "", "", "")), ('{"verdict":"v","severity":3.7}', ("v", "3", "", "", "")), ('{"verdict":"v","severity":true}', ("v", "1", "", "", "")),
    ('{"risk_taxonomy_categories":null,"risk_taxonomies":["x"],"verdict":null,"harmful_intent":null}', ("None", "", "", "", "None")),
    ('{"risk_taxonomies":"one","OWASP_risk_codes":["LLM01",5]}', ("", "", "one", "LLM01; 5", "")), ('{"verdict":"v","harmful_intent":"' + "h" * 600 + '"}', ("v", "", "", "", "h" * 500)),
])
def test_verdicts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(judge.parse_verdict(F.col("t")).alias("v")).select("v.*").first()) == want


def test_render(spark):
    df = spark.createDataFrame([("post", "T", "a </sample> b", True), (None, " ", None, False)], "node_type string, title string, text string, is_truncated boolean")
    got = [r.x for r in df.select(judge.render(df).alias("x")).collect()]
    assert got == ["node_type: post\ntitle: T\ntext:\na </sample> b\n\n[note: this text was truncated during sampling]", "node_type: unknown\ntext:\n"]
    wrapped = df.select(judge.wrap(judge.render(df)).alias("x")).first().x
    assert wrapped.startswith("<sample>\n") and wrapped.count("</sample>") == 1


def test_merge_and_retry(spark):
    cols = "example_num string, node_id string, node_type string, verdict string"
    base = spark.createDataFrame([("1", "a", "post", "x"), ("2", "b", "post", "y")], cols)
    retry = spark.createDataFrame([("9", "a", "zzz", "")], cols)
    assert sorted(tuple(r) for r in judge.merge_retry(base, retry).collect()) == [("1", "a", "post", ""), ("2", "b", "post", "y")]
    assert judge.unknown_retries(base, retry.withColumn("node_id", F.lit("q"))).count() == 1
    with pytest.raises(ValueError):
        judge.merge_retry(base, retry.drop("verdict"))
    results = spark.createDataFrame([("10", "a", "", "error"), ("9", "b", "", "error"), ("9", "b", "", "error"), ("3", "gone", "", "error"), ("1", "c", "", "safe")], cols)
    source = spark.createDataFrame([("a", "ta"), ("b", "tb"), ("c", "tc")], "node_id string, text string")
    assert sorted((r.example_num, r.node_id, r.is_truncated) for r in judge.retry_input(results, source, ["error"]).collect()) == [(1, "b", False), (2, "a", False)]


def test_reconcile(spark):
    ids = spark.createDataFrame([(i,) for i in "abc"], "node_id string")
    ok, bad = spark.createDataFrame([("a",), ("a",), ("z",)], "node_id string"), spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert sorted((r.node_id, r.outcome) for r in judge.reconcile(ids, ok, bad).collect()) == [("a", "success"), ("a", "success"), ("b", "error"), ("c", "missing"), ("z", "success")]


def test_contracts(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k int, y string")
    assert contracts.one_to_one(left, right, "k").count() == 2
    for a, b in ((left.union(left), right), (left, right.union(right)), (right, left)):
        with pytest.raises(contracts.ContractError):
            contracts.one_to_one(a, b, "k")
    assert contracts.content_hash(left).first() == contracts.content_hash(left.orderBy(F.desc("k"))).first() != contracts.content_hash(left.withColumn("x", F.lit("c"))).first()
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(left, ["k", "z"])
    assert contracts.require_columns(left, ["x"]).columns == ["x"]
    p = spark.createDataFrame([(0.5,), (float("nan"),)], "p double")
    assert not p.agg(contracts.probabilities_ok(p, "p").alias("ok")).first().ok and p.limit(1).agg(contracts.probabilities_ok(p, "p").alias("ok")).first().ok


def test_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 1, 0, [1.0, 0.0]), (2, 0, 3, [0.0, 2.0]), (3, 0, 0, [0.0, 0.0])], "owner int, chunk_index long, label int, v array<float>")
    protos = V.contrast_prototypes(df, "label", "v", [3], [0])
    scored = V.contrast_scores(df, "v", protos)
    best = {r.owner: r for r in V.max_chunk(scored, "owner", "score", "chunk_index").collect()}
    assert best[1].trigger_chunk_index == 0 and best[1].num_chunks == 2 and best[1].max_similarity == -1 and best[2].max_similarity == 1 and best[3].max_similarity == 0
    assert spark.range(1).select(V.nearest_label(F.lit(0.0)).alias("x")).first().x == "malicious"
    queries, refs = df.select("owner", "v").filter("owner > 1"), spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(9)], "ref int, v array<float>")
    ranked = lambda **o: [(r.owner, r["rank"], r.ref, round(r.similarity, 9)) for r in V.top_k(queries, "owner", refs, "ref", "v", 4, **o).collect()]
    native = sorted(ranked())
    assert len(native) == 8 and sorted(ranked(block_rows=8)) == native and sorted(ranked(block_rows=2)) == native
    # Blocks leave only the result behind, and none holds the dictionary.
    held, best = [], V._block_best
    monkeypatch.setattr(V, "_block_best", lambda asked, key, block, k: held.append(block.count()) or best(asked, key, block, k))
    before = set(glob.glob(f"{staging.shared_folder(spark).removeprefix('file://')}/lakewarden/*"))
    assert sorted(ranked(block_rows=3)) == native and sum(held) == 9 and max(held) < 9
    left = set(glob.glob(f"{staging.shared_folder(spark).removeprefix('file://')}/lakewarden/*")) - before
    assert ["top-k" in f for f in left] == [True]
    assert V.top_k(queries, "owner", refs.union(refs.limit(0)), "ref", "v", 4, block_rows=1).count() == 8 and V.top_k(queries.limit(0), "owner", refs, "ref", "v", 4, block_rows=2).count() == 0
    monkeypatch.setattr(V, "NATIVE_ROWS", 0)
    assert sorted(ranked()) == native
    profile = {r.c: r for r in V.cluster_profile(spark.createDataFrame([(0, "b", "t1", 0.5, 1), (0, "a", "t2", 0.9, 2)], "c int, cat string, t string, s double, k int"), "c", "cat", "t", "s", "k", 2).collect()}
    assert (profile[0]["size"], profile[0].category, profile[0].rep_text) == (2, "a", "t2") and (profile[1]["size"], profile[1].category) == (0, "")


def test_models(spark):
    rows = [(i, [float(i % 2), float(i % 3)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    out = models.apply_head(models.train_head(df, "v", "y"), df, "v").collect()
    assert all((r.p > 0.5) == (r.y == 1) for r in out)
    assert {r.cluster for r in models.cosine_kmeans(df.filter("id % 6 in (1, 2)"), "id", "v", 2).collect()} == {0, 1}
    assert models.cosine_kmeans(df.limit(1), "id", "v", 5).count() == 1
    enc = models.encode(df.select(F.col("id").cast("string").alias("t")), "t", lambda: lambda texts: [[float(len(t))] for t in texts], normalize=False)
    assert {tuple(r.vector) for r in enc.collect()} == {(1.0,), (2.0,)}
    assert models.check_contract({"a": 1, "batch_size": 1}, {"a": 1, "batch_size": 16}) == ["batch_size"]
    with pytest.raises(ValueError):
        models.check_contract({"a": 2}, {"a": 1})


def test_reports(spark):
    scored = spark.createDataFrame([("a", "post", 0.6, "x"), ("b", "comment", -0.1, "y"), ("c", "comment", 0.4, "x")], "node_id string, node_type string, max_similarity double, nearest_category string")
    sweep = {r.threshold: r for r in report.threshold_sweep(scored, [0.4, 0.9]).collect()}
    assert (sweep[0.4].flagged_count, sweep[0.4].flagged_pct, sweep[0.4].post_count, sweep[0.4].comment_count, sweep[0.4].categories_json) == (2, 66.6667, 1, 1, '{"x":2}')
    assert sweep[0.9].flagged_count == 0 and sweep[0.9].categories_json == "{}"
    assert {r.node_id: r.stratum for r in report.strata_sample(scored, 5).collect()} == {"a": "high_confidence", "c": "near_miss"}
    assert report.unassigned(scored).first().n_unassigned == 1
    nodes = spark.createDataFrame([("a", "post", "1", ""), ("c", "comment", "1", "sub"), ("b", "comment", None, "z")], "node_id string, node_type string, conversation_id string, submolt_name string")
    rolled = report.flagged_conversations(scored, nodes, -1.0).collect()
    assert len(rolled) == 1 and rolled[0].flagged_node_ids == ["a", "c"] and rolled[0].submolt_name == "sub"
    assert report.without_conversation(scored, nodes).first().n_missing == 1
    top = report.top_matches(scored, 2).collect()
    assert [(r.rank, r.node_id, r.title) for r in sorted(top, key=lambda r: r.rank)] == [(1, "a", None), (2, "c", None)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi"\nnow', None), ("2", "back\\slash", "")], "node_id string, text string, more string")
    sinks.csv(df, f"{tmp_path}/c", single=True)
    assert sorted(tuple(r) for r in readers.csv_text(spark, f"{tmp_path}/c").collect()) == [("1", 'say "hi"\nnow', ""), ("2", "back\\slash", "")]
    with pytest.raises(Exception):
        sinks.csv(df, f"{tmp_path}/c")
    sinks.json_lines(df, f"{tmp_path}/j")
    assert readers.json_lines(spark, f"{tmp_path}/j", "node_id string, text string").count() == 2
    sinks.id_list(df, f"{tmp_path}/i")
    assert readers.id_list(spark, f"{tmp_path}/i").count() == 2
    sinks.id_list(df.union(df), f"{tmp_path}/i", overwrite=True)
    with pytest.raises(contracts.ContractError):
        readers.id_list(spark, f"{tmp_path}/i")
    sinks.by_severity(df.select(F.col("node_id").alias("severity"), "text"), f"{tmp_path}/s", "text")
    assert {p.name for p in tmp_path.joinpath("s/text").glob("severity=*")} == {"severity=1", "severity=2"} and not tmp_path.joinpath("s/csv").exists()
    sinks.by_severity(df.select(F.col("node_id").alias("severity"), "text", "more"), f"{tmp_path}/s", "text")
    assert {p.name for p in tmp_path.joinpath("s/csv").glob("severity=*")} == {"severity=1", "severity=2"}
    assert readers.if_exists(spark, f"{tmp_path}/none", "a int").count() == 0
    names = spark.createDataFrame([("x/head_epoch10.pt",), ("head_epoch9.pt",), ("other.pt",)], "path string")
    assert [r.epoch for r in readers.checkpoints(names).collect()] == [9, 10]
    assert sinks.merge_manifest({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    assert json.loads(sinks.manifest_text(sinks.manifest(spark, {"df": df}, {"x": 1})))["inputs"]["df"]["n_rows"] == 2
    assert readers.prompt(" x ") == "x"
    with pytest.raises(ValueError):
        readers.prompt(" ")


def test_loop_judges_every_row_once(spark, tmp_path):
    schema, seen = "node_id string, text string", []

    def ask(batch):
        seen.extend(r.node_id for r in batch.collect())
        return batch.filter("text != 'fails'").select("node_id", F.lit("safe").alias("verdict"))

    go = lambda: judge_loop.run(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", "node_id string, verdict string", f"{tmp_path}/cp", ask).awaitTermination()
    spark.createDataFrame([("a", "x"), ("b", "fails"), ("a", "x")], schema).write.parquet(f"{tmp_path}/in")
    go()
    spark.createDataFrame([("a", "x"), ("b", "again"), ("c", "y")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.node_id for r in out.collect()) == ["a", "b", "c"] and sorted(seen) == ["a", "b", "b", "c"]
    assert judge_loop.rate_limit(0) == 2 and judge_loop.rate_limit(5) is None


def test_refusals(spark, tmp_path):
    """What must not pass in silence raises when rows are computed."""
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 0), (3, [0.9, 0.1], 1), (4, [0.1, 0.9], 0)], "id int, v array<double>, y int")
    head = models.train_head(vectors, "v", "y")
    models.save_head(head, spark, f"{tmp_path}/head")
    want = {r.id: r.p for r in models.apply_head(head, vectors, "v").collect()}
    assert {r.id: r.p for r in models.apply_saved_head(vectors, "v", f"{tmp_path}/head").collect()} == want
    wide = vectors.withColumn("v", F.concat("v", F.array(F.lit(1.0))))
    for apply in (lambda: models.apply_head(head, wide, "v"), lambda: models.apply_saved_head(wide, "v", f"{tmp_path}/head")):
        with pytest.raises(ValueError, match="width"):
            apply()
    text = spark.createDataFrame([("3.7",)], "s string")
    with pytest.raises(Exception, match="whole number"):
        text.select(judge.severity_text(F.col("s"))).collect()
    for bad in ("1", None):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([(bad,)], "s string").select(judge.binary_label(F.col("s"), strict=True)).collect()
    rows = spark.createDataFrame([("1", "a", "post", "x")], "example_num string, node_id string, node_type string, verdict string")
    with pytest.raises(Exception, match="repeated retry id"):
        judge.merge_retry(rows, rows.union(rows)).collect()
    assert judge.batch_ready("completed")
    with pytest.raises(ValueError, match="in_progress"):
        judge.batch_ready("in_progress")


def test_last_duplicate_and_zero_vectors(spark):
    scored = spark.createDataFrame([("n", 0.9, "t")], "node_id string, max_similarity double, nearest_threat_id string")
    twice = spark.createDataFrame([("t", "first"), ("t", "last")], "threat_id string, attack_text string").coalesce(1)
    assert [r.nearest_attack_text for r in report.top_matches(scored, 5, None, twice).collect()] == ["last"]
    vectors = spark.createDataFrame([(k, [float(k % 2), float(1 - k % 2)]) for k in range(6)] + [(9, [0.0, 0.0]), (10, None)], "id int, v array<double>")
    placed = {r.id: r for r in models.cosine_kmeans(vectors, "id", "v", 2).collect()}
    assert set(placed) == {*range(6), 9} and (placed[9].cluster, placed[9].similarity) == (0, 0.0) and placed[0].cluster != placed[1].cluster
    assert {r.similarity for r in models.cosine_kmeans(vectors.filter("id in (0, 2)"), "id", "v", 1).collect()} == {1.0}
    protos = V.contrast_prototypes(vectors.withColumn("label", F.lit(3)), "label", "v", [3], [0], vectors.filter("id = 1")).first()
    assert protos.benign == [1.0, 0.0]
    said = models.detect_language(spark.createDataFrame([("hello world",), ("x",), (None,)], "t string"), "t", lambda: lambda texts: ["EN" if " " in t else None for t in texts], 3)
    assert [r.language for r in said.collect()] == ["en", "und", "und"]


def test_judge_loop_tries_again(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "node_id string").write.parquet(f"{tmp_path}/asked")
    tried, slept = [], []

    def moody(rows):
        tried.append(1)
        if len(tried) < 3:
            raise OSError("busy")
        return rows

    judge_loop.run(spark, f"{tmp_path}/asked", "node_id string", f"{tmp_path}/out", "node_id string", f"{tmp_path}/cp", moody, per_minute=30, sleep=slept.append).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and slept[:2] == [2, 4] and 0 < slept[2] <= 4
