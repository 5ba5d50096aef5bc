"""The shared folder: a session's setting wins; a local session without one keeps a folder of its own."""

import os

import pytest
from pyspark.sql import functions as F

from lakewarden.plans import io_plans
from lakewarden.sources import staging


class Session:
    def __init__(self, setting, master="local[2]", app="a"):
        self.conf, self.sparkContext = self, self
        self.setting, self.master, self.applicationId = setting, master, app

    def get(self, name, default=None):
        return self.setting or default


def test_shared_folder():
    assert staging.shared_folder(Session("file:///shared/")) == "file:///shared"
    own = staging.shared_folder(Session(None))
    assert own == staging.shared_folder(Session("")) and own != staging.shared_folder(Session(None, app="b"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session(None, "spark://host:7077"))


def test_stage(spark):
    df = staging.stage(spark.range(3), "test")
    assert df.count() == 3
    files = df.inputFiles()
    staging.discard(df)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def staged(spark, label):
    folder = staging.shared_folder(spark).removeprefix("file://") + "/lakewarden"
    return {name for name in (os.listdir(folder) if os.path.isdir(folder) else ()) if name.startswith(f"{label}-")}


@pytest.mark.parametrize("name, label, table", [("content_hash", "copy", "documents"), ("fold_reconcile", "folds", "labels")])
def test_copies_are_written_by_as_many_tasks_as_their_size_needs(spark, tmp_path, name, label, table):
    """Half of the texts are equal, and the table is many times AQE's size of a task."""
    n = 20_000
    digest = F.concat(*[F.sha2(F.concat("id", F.lit(k)), 256) for k in "abc"])
    rows = spark.range(0, n, 1, 16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "of one text").otherwise(digest).alias("text"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows.write.parquet(f"{tmp_path}/{table}.parquet")
    before = staged(spark, label)
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for key in sizes:
        spark.conf.set(key, "16k")
    try:
        found = getattr(io_plans, name)(spark, str(tmp_path)).collect()
    finally:
        for key in sizes:
            spark.conf.unset(key)
    (new,) = staged(spark, label) - before
    copy = spark.read.parquet(f"{staging.shared_folder(spark)}/lakewarden/{new}")
    by_file = [r["count"] for r in copy.groupBy(F.input_file_name()).count().collect()]
    assert sum(by_file) == n and max(by_file) * 4 <= n and len(by_file) >= 4
    if name == "content_hash":
        assert [tuple(r) for r in found] == [(n, True, True)]
    else:
        assert len(found) == 10 and sum(r.n for r in found) == 2 * n


def test_dealt_rows_change_their_order(spark):
    """A small table too, whose copy is one file."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copy = staging.stage_dealt(docs, "test", "doc_id")
    own, dealt = ([r.doc_id for r in x.select("doc_id").collect()] for x in (docs, copy))
    assert sorted(own) == sorted(dealt) and own != dealt
    staging.discard(copy)
