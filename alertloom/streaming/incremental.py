"""The same work on pages as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.config import Rules, Settings
from alertloom.plans.alert_run import alert_run, finish
from alertloom.session import new_path
from alertloom.sources.seen import SeenStore
from alertloom.sources.seen_log import SeenLog

PAGES_SCHEMA = (
    "task_id long, source string, kind string, page_url string, default_location string, "
    "company_hint string, html string"
)


def page_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New page files under ``path`` as a stream."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def incremental_alerts(
    pages: DataFrame,
    store: SeenStore | SeenLog,
    out_path: str,
    as_of: Callable[[int], Column],
    checkpoint: str,
    rules: Rules = Rules(),
    settings: Settings = Settings(),
    deliver: Callable[[DataFrame], bool] | None = None,
    detail_pages: DataFrame | None = None,
    day_first: bool = False,
) -> StreamingQuery:
    """Alert on every micro-batch of pages, with the state carried between batches.

    ``checkpoint`` is the stream's identity and must stay the same from start to start.  A
    batch reads the latest state that it did not write itself, so one that is run again
    after a failure starts from the same state and replaces its own digest.  If
    ``deliver`` fails, so does the batch: the stream stops, and its next start
    delivers the same rows again.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        tag = f"{stream}-{batch_id}"
        done = alert_run(batch, store.current(not_by=tag), as_of(batch_id), rules, settings, detail_pages, day_first)
        done.digest.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        if deliver and not deliver(done.messages):
            raise RuntimeError(f"batch {batch_id} was not delivered")
        finish(done, store, lambda _: True, tag=tag)

    return (
        pages.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_alert_per_key(events: DataFrame, keys: list[str], time: str, retention: str = "90 days") -> DataFrame:
    """Each key once per retention period, in order of arrival.

    Spark keeps one small state row per key and forgets it when the watermark has passed
    the retention, so state is bounded by the keys of one period.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, retention).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything that is there and read back what it wrote."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_path(spark, f"{name}-log"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
