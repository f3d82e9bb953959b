"""Failures by cause and time, counted as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.runs import diagnosed_events

COUNT_SCHEMA = "window_start timestamp, probable_cause string, n bigint, batch_id bigint"


def failure_counts(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """``(window_start, probable_cause, n)`` of failed events; batch or stream."""
    failed = diagnosed_events(events).where(F.col("error_message").isNotNull())
    if failed.isStreaming:
        failed = failed.withWatermark("timestamp", watermark)
    counts = failed.groupBy(
        F.window("timestamp", window).alias("window"), F.col("diagnosis.probable_cause").alias("probable_cause")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "probable_cause", "n")


def stream_failures(
    events: DataFrame,
    store: str,
    checkpoint: str,
    window: str = "1 day",
    watermark: str = "1 hour",
    trigger: dict | None = None,
    final: bool = False,
) -> StreamingQuery:
    """Write the counts that changed in each batch to a partition of that batch.

    A batch that runs again replaces its partition. Open windows show up at
    once and not only when the watermark has passed them; with ``final`` a
    window shows up when it has, once, and is never changed again. An event whose
    window was closed before it came is in no count; ``late_counts`` tells how many were.
    """

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    return (
        failure_counts(events, window, watermark)
        .writeStream.outputMode("append" if final else "update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_failures(spark: SparkSession, store: str) -> DataFrame:
    """The latest count of every window and cause."""
    return (
        spark.read.schema(COUNT_SCHEMA)
        .parquet(store)
        .groupBy("window_start", "probable_cause")
        .agg(F.max_by("n", "batch_id").alias("n"))
    )


def late_counts(events: DataFrame, closed: DataFrame, window: str = "1 day") -> DataFrame:
    """``(window_start, probable_cause, n, n_late)`` of the closed windows.

    ``closed`` holds the windows of a stream with ``final``, ``events`` all that
    has arrived, as a batch. Windows close in order, so those up to the last
    one of ``closed`` are; what they hold besides its counts came late.
    """
    last = closed.agg(F.max("window_start").alias("_last"))  # one row
    every = failure_counts(events, window).withColumnRenamed("n", "_all").join(F.broadcast(last), how="cross")
    every = every.where(F.col("window_start") <= F.col("_last"))
    counted = every.join(closed, ["window_start", "probable_cause"], "left")
    n = F.coalesce("n", F.lit(0))
    return counted.select("window_start", "probable_cause", n.alias("n"), (F.col("_all") - n).alias("n_late"))
