"""Physical plans: pruned scans, pushed filters, no Python on native paths, bounded broadcasts."""

import re

import pytest

from lakewarden.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, table, columns", [("mask_emails", "documents", {"doc_id", "text"}), ("value_counts_head", "documents", {"source"}), ("contrast_flag_summary", "embeddings", {"label", "embedding"}), ("binary_labels", "labels", {"doc_id", "toxic"})])
def test_scans_read_needed_columns_only(spark, name, table, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", plan(spark, name))
    assert schemas
    for schema in schemas:
        assert {c.split(":")[0] for c in schema.split(",") if ":" in c} <= columns


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*turn", plan(spark, "node_compose"))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"kmeans_cosine", "head_logreg", "vector_topk", "scan_example"}))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)


def test_samples_keep_n_rows_a_task(spark):
    assert "TakeOrderedAndProject" in plan(spark, "sample_simple")
    assert "WindowGroupLimit" in plan(spark, "sample_stratified")
