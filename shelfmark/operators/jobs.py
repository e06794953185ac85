"""Batch decisions, candidate selection and job reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import genres as gx
from shelfmark.operators.common import percent
from shelfmark.operators.genres import AnyTaxonomy, with_merged, with_normalized
from shelfmark.refdata import AUTO_THRESHOLD, LOW_THRESHOLD, MEDIUM_THRESHOLD, SECONDS_PER_ALBUM, Taxonomy


def decision_status(confidence: Column, threshold: Column | float = AUTO_THRESHOLD) -> Column:
    return (F.when(confidence >= threshold, "completed")
            .when(confidence >= LOW_THRESHOLD, "needs_review").otherwise("skipped"))


def decision_reason(confidence: Column, threshold: Column | float = AUTO_THRESHOLD) -> Column:
    """Why a result is not applied; null when it is."""
    return (F.when(confidence >= threshold, F.lit(None).cast("string"))
            .when(confidence >= MEDIUM_THRESHOLD, F.format_string("Medium confidence (%.1f%%) - requires manual review",
                                                                  confidence))
            .when(confidence >= LOW_THRESHOLD, F.format_string("Low confidence (%.1f%%) - uncertain match", confidence))
            .otherwise(F.format_string("Very low confidence (%.1f%%) - no reliable match found", confidence)))


def decide(results: DataFrame, tax: AnyTaxonomy, threshold: float = AUTO_THRESHOLD, genre_limit: int | None = None
           ) -> DataFrame:
    """Adds status, final_genres and manual_review_reason to matched albums.

    ``results``: original_genres, suggested_genres, confidence and, optionally,
    error_message; rows with an error are ``failed`` and keep their genres.
    ``genre_limit`` cuts the merged list; without it every genre is kept.
    """
    c = F.col("confidence")
    failed = F.col("error_message").isNotNull() if "error_message" in results.columns else F.lit(False)
    status = F.when(failed, "failed").otherwise(decision_status(c, threshold))
    merged = with_merged(results, "original_genres", "suggested_genres", tax, "_accepted", genre_limit)
    return (merged.withColumn("status", status)
            .withColumn("final_genres", F.when(F.col("status") == "completed", F.col("_accepted"))
                        .otherwise(F.col("original_genres"))).drop("_accepted")
            .withColumn("manual_review_reason", F.when(~failed, decision_reason(c, threshold))))


def artist_range(df: DataFrame, span: str) -> DataFrame:
    """Artists whose initial lies in ``a-c``; a malformed span keeps every row."""
    ends = span.lower().split("-")
    if len(ends) != 2 or not all(ends):
        return df
    return df.where(F.lower(F.substring("artist", 1, 1)).between(*ends))


def specific_album(df: DataFrame, wanted: str) -> DataFrame:
    """The album named ``Artist,Album``, without case; a name without a comma is refused."""
    artist, comma, album = wanted.partition(",")
    if not comma:
        raise ValueError(f"not of the form 'Artist,Album': {wanted!r}")
    return df.where((F.lower("artist") == artist.strip().lower()) & (F.lower("album") == album.strip().lower()))


PRIORITIES = {"high": 1, "medium": 2, "low": 3}


def processing_candidates(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """Albums to process: no genres (high), mostly invalid (medium), some invalid (low)."""
    n_valid, n_invalid = F.col("n_valid"), F.col("n_invalid")
    priority = (F.when(F.size("genres") <= 0, "high").when(n_invalid > n_valid, "medium").when(n_invalid > 0, "low"))
    rank = F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    return (with_normalized(albums, tax).withColumn("priority", priority).drop("normalized", "n_valid", "n_invalid")
            .where("priority IS NOT NULL").withColumn("priority_rank", rank))


def candidate_counts(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    return processing_candidates(albums, tax).groupBy("priority").agg(F.count(F.lit(1)).alias("n_albums"))


def next_batch(candidates: DataFrame, n: int) -> DataFrame:
    """First ``n`` candidates by priority."""
    return candidates.orderBy("priority_rank", "album_key").limit(n)


def select_for_job(albums: DataFrame, keys: DataFrame) -> DataFrame:
    """Albums of a job's key list."""
    return albums.join(keys, "album_key", "left_semi")


def unknown_keys(albums: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of a job's list that the library does not have."""
    return keys.join(albums, "album_key", "left_anti")


def eta_text(remaining: Column, seconds_per_album: int = SECONDS_PER_ALBUM) -> Column:
    """Rough time left, as text."""
    total = remaining * seconds_per_album
    hours = F.floor(total / 3600).cast("int")
    minutes = F.floor((total % 3600) / 60).cast("int")
    return (F.when(remaining <= 0, "Completed")
            .when(hours > 0, F.format_string("~%dh %dm remaining", hours, minutes))
            .otherwise(F.format_string("~%dm remaining", minutes)))


def result_counters(results: DataFrame) -> DataFrame:
    """Counts per job and outcome."""
    s = F.col("status")
    return results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(s.isin("completed", "approved")).alias("successful"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "needs_review").alias("needs_review"),
        F.count_if(s == "skipped").alias("skipped"))


def job_summary(jobs: DataFrame, results: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Progress of each job, derived from its result rows."""
    done = result_counters(results)
    out = jobs.select("job_id", "total_albums").join(done, "job_id", "left")
    if queue is not None:
        waiting = queue.where("reviewed_at IS NULL").groupBy("job_id").agg(F.count(F.lit(1)).alias("review_queue"))
        out = out.join(waiting, "job_id", "left")
    else:
        out = out.withColumn("review_queue", F.col("needs_review"))
    counters = ["processed", "successful", "failed", "needs_review", "skipped", "review_queue"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counters})
    return (out.withColumn("progress_percent", percent(F.col("processed"), F.col("total_albums")))
            .withColumn("success_rate", percent(F.col("successful"), F.col("processed")))
            .withColumn("eta", F.when(F.col("processed") > 0, eta_text(F.col("total_albums") - F.col("processed")))))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))


def confidence_bucket(c: Column) -> Column:
    return (F.when(c >= 90, "90%+").when(c >= 80, "80-89%").when(c >= 70, "70-79%").when(c >= 50, "50-69%")
            .otherwise("<50%"))


def confidence_histogram(results: DataFrame) -> DataFrame:
    return (results.groupBy("job_id", confidence_bucket(F.col("confidence")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def confidence_deciles(results: DataFrame) -> DataFrame:
    """Results per ten points of confidence."""
    return (results.groupBy((F.floor(F.col("confidence") / 10) * 10).cast("int").alias("decile"))
            .agg(F.count(F.lit(1)).alias("n")))


def genre_additions(results: DataFrame) -> DataFrame:
    """Per job: albums that gained genres, and genres gained."""
    gained = F.size("final_genres") - F.size("original_genres")
    return (results.where("final_genres IS NOT NULL").groupBy("job_id")
            .agg(F.count_if(gained > 0).alias("albums_with_additions"),
                 F.coalesce(F.sum(F.when(gained > 0, gained)), F.lit(0)).cast("bigint").alias("total_additions")))


def with_diff(results: DataFrame) -> DataFrame:
    return results.withColumn("diff", gx.list_diff("original_genres", "suggested_genres", "final_genres"))


def result_detail(results: DataFrame, job_id: str, album_key: str) -> DataFrame:
    """One result with its list differences."""
    return with_diff(results.where((F.col("job_id") == job_id) & (F.col("album_key") == album_key)))


def filtered_results(results: DataFrame, job_id: str | None = None, status: str | None = None,
                     changes_only: bool = False) -> DataFrame:
    out = results if job_id is None else results.where(F.col("job_id") == job_id)
    if status and status != "all":
        out = out.where(F.col("status") == status)
    out = with_diff(out)
    return out.where("diff.has_changes") if changes_only else out


def result_page(results: DataFrame, job_id: str | None = None, status: str | None = None, changes_only: bool = False,
                page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of results, most confident and newest first; filters apply before paging."""
    return (filtered_results(results, job_id, status, changes_only)
            .orderBy(F.desc("confidence"), F.desc("created_at"), "album_key")
            .offset((page - 1) * per_page).limit(per_page))


def review_queue(results: DataFrame, priority: Column | None = None) -> DataFrame:
    """Results that wait for a decision; all have priority 1 unless one is given."""
    return results.where("status = 'needs_review'").select(
        "job_id", "album_key", "artist", "album", "suggested_genres", "confidence",
        (F.lit(1) if priority is None else priority).alias("priority"),
        F.coalesce("manual_review_reason", F.lit("Needs review")).alias("reason"), "created_at",
        F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewer_decision"))


def open_reviews(queue: DataFrame, job_id: str | None = None, limit: int = 50) -> DataFrame:
    """Unreviewed entries, highest priority and oldest first."""
    out = queue.where("reviewed_at IS NULL")
    out = out if job_id is None else out.where(F.col("job_id") == job_id)
    return out.orderBy(F.desc("priority"), "created_at", "job_id", "album_key").limit(limit)


def recent_jobs(jobs: DataFrame, n: int | None = None) -> DataFrame:
    """Jobs, newest first."""
    out = jobs.orderBy(F.desc("created_at"), "job_id")
    return out.limit(n) if n else out


def recent_results(results: DataFrame, n: int = 10) -> DataFrame:
    """Latest results over all jobs."""
    return results.orderBy(F.desc("created_at"), "job_id", "album_key").limit(n)
