"""Progress of a running batch as windowed counts over an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def progress_windows(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", ts: str = "ts",
                     status: str = "status") -> DataFrame:
    """Counts per time window; works on a stream and on a table alike.

    Windowed aggregation is partial before its shuffle, so a hot status or window costs no
    more than one row per task.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", watermark)

    def count(name: str) -> Column:
        return F.count_if(F.col(status) == name)

    counted = timed.groupBy(F.window("_ts", window)).agg(
        F.count("*").alias("n_completed"),
        count("success").alias("n_success"), count("no_result").alias("n_no_result"), count("failed").alias("n_failed"),
    )
    return counted.select(
        F.col("window.start").alias("window_start"), "n_completed", "n_success", "n_no_result", "n_failed"
    )


def run_progress(counted: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the windows that each micro-batch has changed to ``out/batch=<id>``; a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counted.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_progress(spark: SparkSession, out: str) -> DataFrame:
    """The newest counts of every window, open ones included."""
    counts = ["n_completed", "n_success", "n_no_result", "n_failed"]
    written = spark.read.parquet(out)
    return written.groupBy("window_start").agg(F.max_by(F.struct(*counts), "batch").alias("c")).select("window_start", "c.*")
