"""Progress counters, rates and time texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.common import latest, percent
from shelfmark.operators.jobs import result_counters
from shelfmark.operators.ordered import trailing_count


def progress_counters(results: DataFrame, now: Column) -> DataFrame:
    """One row: processed, applied, by confidence, in the last five minutes and the last hour."""
    c, s, t = F.col("confidence"), F.col("status"), F.col("created_at")
    return results.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if((s == "completed") & (F.col("files_updated") > 0)).alias("completed"),
        F.count_if((c >= 75) & (s == "completed")).alias("high_confidence"),
        F.count_if((c < 75) & (c >= 50)).alias("medium_confidence"),
        F.count_if(c < 50).alias("low_confidence"),
        F.count_if(t > now - F.expr("INTERVAL 5 MINUTES")).alias("last_5_minutes"),
        F.count_if(t > now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"))


def relative_time(ts: Column, now: Column) -> Column:
    """"just now", "5 mins ago", "2 hours ago"."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(ts)
    minutes, hours = F.floor(seconds / 60).cast("int"), F.floor(seconds / 3600).cast("int")

    def text(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, text(minutes, "min")).otherwise(text(hours, "hour"))


def trailing_rate(results: DataFrame, seconds: int = 300) -> DataFrame:
    """Each result with the number of results of its job in the five minutes up to it."""
    return trailing_count(results, "job_id", "created_at", seconds, "recent")


def latest_per_job(results: DataFrame) -> DataFrame:
    """Last album each job finished."""
    return latest(results, ["job_id"], ["created_at", "album_key"], ["album_key", "artist", "album", "status",
                                                                     "confidence", "created_at"])


def live_progress(jobs: DataFrame, results: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Progress, rate and time left of each job, with the album it finished last."""
    recent = results.groupBy("job_id").agg(
        F.count_if(F.col("created_at") > now - F.expr(f"INTERVAL {minutes} MINUTES")).alias("recent"))
    last = latest_per_job(results).select("job_id", F.col("album_key").alias("latest_album"),
                                          F.col("created_at").alias("latest_at"))
    out = (jobs.select("job_id", "total_albums").join(result_counters(results), "job_id", "left")
           .join(recent, "job_id", "left").join(last, "job_id", "left"))
    names = ["processed", "successful", "failed", "needs_review", "skipped", "recent"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in names})
    left = F.col("total_albums") - F.col("processed")
    return (out.withColumn("progress_percent", percent(F.col("processed"), F.col("total_albums")))
            .withColumn("eta_minutes", F.when((F.col("recent") > 0) & (left > 0),
                                              F.floor(left / F.col("recent") * minutes).cast("int"))))
