"""Batch enrichment: choose albums, match, merge votes, decide, store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import jobs as jb
from shelfmark.operators import matching as mt
from shelfmark.refdata import AUTO_THRESHOLD, Taxonomy, with_default_options
from shelfmark.session import materialize
from shelfmark.sources import store
from shelfmark.sources.config import enabled_sources


def enrich(albums: DataFrame, candidates: DataFrame, votes: DataFrame, tax: Taxonomy, job_id: str, now: Column,
           threshold: float = AUTO_THRESHOLD, genre_limit: int | None = None) -> DataFrame:
    """Result rows for the given albums; the decision follows the confidence of the genres."""
    matched = mt.match_library(albums, candidates, votes)
    rows = matched.join(albums.select(F.col("album_key").alias("entity_key"), F.col("genres").alias("original_genres")),
                        "entity_key")
    proposed = rows.select(F.lit(job_id).alias("job_id"), F.col("entity_key").alias("album_key"), "artist", "album",
                           "original_genres", F.col("final_genres").alias("suggested_genres"), "confidence",
                           "sources_used", "match_confidence")
    return jb.decide(proposed, tax, threshold, genre_limit).withColumn("created_at", now)


def change_plan(results: DataFrame, tracks: DataFrame) -> DataFrame:
    """Files to be retagged by accepted results: file_path and the genre text to write."""
    accepted = results.where("status = 'completed'").select(
        "album_key", F.array_join("final_genres", "; ").alias("new_genre"))
    return tracks.select("album_key", "file_path", F.col("genre").alias("old_genre")).join(accepted, "album_key").where(
        F.coalesce("old_genre", F.lit("")) != F.col("new_genre"))


def of_enabled(rows: DataFrame, options: dict[str, object]) -> DataFrame:
    """The rows of sources that the options leave on; without a list of sources all are on."""
    return rows.where(F.col("source").isin(enabled_sources(options))) if options.get("sources") else rows


def run_job(albums: DataFrame, candidates: DataFrame, votes: DataFrame, tax: Taxonomy, path: str, job_id: str,
            name: str, now: Column, options: dict[str, object] | None = None, limit: int | None = None,
            dry_run: bool = True) -> DataFrame:
    """Candidates in priority order through ``enrich``; job, result and review rows are kept under the job's id.

    Obeyed options: ``confidence_threshold``, ``max_genres_per_album``, ``sources``. ``limit`` takes the first albums of
    the order only. A job that runs again under its id takes the place of the first. Returns the stored results.
    """
    spark = albums.sparkSession
    known = with_default_options(options)
    threshold, genres = float(known["confidence_threshold"]), int(known["max_genres_per_album"])
    chosen = jb.processing_candidates(albums, tax)
    if limit is not None:
        chosen = jb.next_batch(chosen, limit)
    job = store.create_job(spark, job_id, name, chosen, threshold, dry_run, now, json.dumps(known, sort_keys=True))
    results = materialize(enrich(chosen.select(*albums.columns), of_enabled(candidates, known), of_enabled(votes, known),
                                 tax, job_id, now, threshold, genres), "results")
    store.write_run({"jobs": job, "job_results": results, "review_queue": jb.review_queue(results)}, path, "job_id", job_id)
    return store.read_log(spark, path, "job_results", "job_id").where(F.col("job_id") == job_id)
