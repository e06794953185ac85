"""Progress of running jobs as streams.

Input: result rows with ``created_at`` as a UTC timestamp. Windows, sessions and
first results keep state up to the watermark; rows later than it are dropped by
Spark. ``job_progress`` groups by job only and keeps one state row per job for
good. ``batch_counters`` tells what each batch read, dropped and holds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas

WATERMARK = "10 minutes"


def read_results(spark: SparkSession, path: str, schema: str = schemas.JOB_RESULTS, max_files: int = 100) -> DataFrame:
    """Stream over a growing folder of result files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _marked(results: DataFrame, watermark: str) -> DataFrame:
    return results.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark(
        "created_at", watermark)


def job_progress(results: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Running counters and the latest album of each job (update mode; one state row per job)."""
    s = F.col("status")
    return _marked(results, watermark).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(s.isin("completed", "approved")).alias("successful"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "needs_review").alias("needs_review"),
        F.count_if(s == "skipped").alias("skipped"),
        F.max_by("album_key", F.struct("created_at", "album_key")).alias("latest_album"),
        F.max("created_at").alias("latest_at"))


def sliding_rate(results: DataFrame, length: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK
                 ) -> DataFrame:
    """Results per job in sliding windows."""
    return (_marked(results, watermark).groupBy("job_id", F.window("created_at", length, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("job_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))


def hourly_throughput(results: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Results per hour with their mean confidence."""
    return (_marked(results, watermark).groupBy(F.window("created_at", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
            .select(F.col("w.start").alias("hour"), "n", "mean_confidence"))


def activity_sessions(results: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Spells of activity per job, closed after a gap."""
    return (_marked(results, watermark).groupBy("job_id", F.session_window("created_at", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("job_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))


def first_results(results: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """First result of each (job, album) within the watermark; repeats are dropped."""
    return _marked(results, watermark).dropDuplicatesWithinWatermark(["job_id", "album_key"])


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", timeout: int | None = None,
                  counters: str | None = None) -> None:
    """Process what is there and stop; ``counters`` names a table for the counters of its batches.

    Update mode writes each batch's changed rows with their batch id; the newest
    row per key is the current value (``current``). A batch that runs again
    after a failure replaces its own folder, so nothing is counted twice.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(_keep_batch(out)).start()
    query.awaitTermination(timeout)
    if counters is not None:
        save_counters(query, stream.sparkSession, counters)


COUNTERS = ("run_id string, batch_id long, read long, late long, repeated long, held long, "
            "watermark timestamp")


def batch_counters(query) -> list[tuple]:
    """A row for each finished batch that the query still knows: rows read, dropped as late, dropped as repeats, and rows
    of state after it.

    Spark keeps the progress of the last ``spark.sql.streaming.numRecentProgressUpdates`` batches. Rows that are late
    for several operators of a query count for each.
    """
    out = {}
    for p in query.recentProgress:
        ops = p["stateOperators"]
        mark = p["eventTime"].get("watermark")
        out[p["batchId"]] = (
            str(p["runId"]), p["batchId"], p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in ops),
            sum(int(o["customMetrics"].get("numDroppedDuplicateRows", 0)) for o in ops),
            sum(o["numRowsTotal"] for o in ops),
            dt.datetime.fromisoformat(mark.replace("Z", "+00:00")) if mark else None)
    return [out[k] for k in sorted(out)]


def save_counters(query, spark: SparkSession, path: str) -> None:
    """Write the counters of a query's batches to a table. A run has a folder of its own, so saving twice changes nothing."""
    rows = spark.createDataFrame(batch_counters(query), COUNTERS)
    rows.write.mode("overwrite").parquet(f"{path}/run={query.runId}")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of all saved runs."""
    return spark.read.schema(COUNTERS).parquet(f"{path}/*")


def _keep_batch(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def current(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode output."""
    rows = spark.read.option("basePath", out).parquet(out)
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*"))
