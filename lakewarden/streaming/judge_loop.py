"""The resumable judging loop as a stream: files of asked rows in, one durable verdict a row out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakewarden.operators.judge import pending
from lakewarden.sources.readers import if_exists


def run(spark: SparkSession, asked_path: str, asked_schema: str, results_path: str, results_schema: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], key: str = "node_id", available_now: bool = True, max_files: int = 10, per_minute: int | None = None, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Judge every asked row once.

    A batch whose judge fails is tried again after growing pauses, and, with
    ``per_minute``, a batch lasts at least as long as its rows may take.

    Each micro-batch is anti-joined with what is stored, judged and appended
    under its batch number, so a batch that runs again after a crash writes the
    same folder. Rows the judge gives nothing for are not stored and come again
    when their file is asked anew.
    """
    asked = spark.readStream.schema(asked_schema).option("maxFilesPerTrigger", max_files).parquet(asked_path)

    def step(batch: DataFrame, number: int) -> None:
        earlier = if_exists(spark, results_path, results_schema + ", batch long").filter(f"batch != {number}")
        fresh = pending(batch.dropDuplicates([key]), earlier, key)
        began, attempt = time.monotonic(), 0
        while True:
            try:
                judge(fresh).write.mode("overwrite").parquet(f"{results_path}/batch={number}")
                break
            except Exception:
                if (wait := rate_limit(attempt)) is None:
                    raise
                sleep(wait)
                attempt += 1
        if per_minute:
            sleep(max(0.0, fresh.count() * 60 / per_minute - (time.monotonic() - began)))

    writer = asked.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rate_limit(attempt: int, base: float = 2.0, most: int = 5) -> float | None:
    """Seconds to wait before the next try: base ** (attempt + 1); None when tries are used up."""
    return None if attempt >= most else base ** (attempt + 1)
