"""Decisions, candidates, job reports, progress."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from shelfmark.operators import jobs as jb
from shelfmark.operators import matching as mt
from shelfmark.operators import progress as pr
from shelfmark.operators import registry as rg
from shelfmark.plans import enrich
from shelfmark.session import materialize, scratch_path
from shelfmark.sources import store
from suite import bindings as b
from suite.q_matching import VOTES, part_votes

QUERIES = {}


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


def r6(c):
    return F.round(c, 6)


def decided(s, d):
    """Every entity with the raw categories of its orders and what the sources voted for."""
    own = b.table(s, d, "orders").where(b.raw_genre() != "").groupBy(F.col("o_custkey").cast("string").alias("entity_key")).agg(
        F.array_sort(F.collect_set(b.raw_genre())).alias("original_genres"))
    votes = mt.aggregate_votes(b.vote_entities(s, d), b.votes(s, d)).withColumnRenamed("final_genres", "suggested_genres")
    return jb.decide(votes.join(own, "entity_key", "left").withColumn("original_genres", F.coalesce(
        "original_genres", F.array().cast("array<string>"))), b.TAX, 90.0)


def prefixed(prefix, definitions):
    """The definitions under names of their own."""
    return {f"{prefix}{k}": re.sub(rf"\b({'|'.join(definitions)})\b(?!\.)", rf"{prefix}\1", v)
            for k, v in definitions.items()}


DECIDED = {
    **VOTES,
    "own_lists": f"""SELECT CAST(o_custkey AS VARCHAR) AS album_key, list_sort(list(DISTINCT {b._RAW})) AS genres
                     FROM orders WHERE {b._RAW} <> '' GROUP BY 1""",
    "voted_lists": "SELECT entity_key AS album_key, final_genres AS genres FROM aggregated",
    **prefixed("x_", b.lists_sql("own_lists")), **prefixed("y_", b.lists_sql("voted_lists")),
    "x_sorted": "SELECT album_key, list_sort(list(genre)) AS g FROM x_norm_list GROUP BY 1",
    "y_sorted": "SELECT album_key, list_sort(list(genre)) AS g FROM y_norm_list GROUP BY 1",
    "joined": """SELECT entity_key, coalesce(o.genres, []) AS original, list_concat(coalesce(x.g, []), list_filter(
                        coalesce(y.g, []), lambda e: NOT list_contains(coalesce(x.g, []), e))) AS g
                 FROM aggregated a LEFT JOIN own_lists o ON o.album_key = entity_key
                 LEFT JOIN x_sorted x ON x.album_key = entity_key LEFT JOIN y_sorted y ON y.album_key = entity_key""",
    "more": """SELECT entity_key, list_sort(list(DISTINCT parent)) AS p
               FROM (SELECT entity_key, g, unnest(g) AS e FROM joined) JOIN tax_parents ON child = e
               WHERE NOT list_contains(g, parent) GROUP BY 1""",
}
add("batch_decisions",
    lambda s, d: decided(s, d).select("entity_key", "confidence", "status", F.array_join("final_genres", "~").alias(
        "final_genres"), "manual_review_reason"),
    """SELECT entity_key, confidence, CASE WHEN confidence >= 90 THEN 'completed' WHEN confidence >= 40
              THEN 'needs_review' ELSE 'skipped' END AS status,
              array_to_string(CASE WHEN confidence >= 90 THEN list_concat(g, coalesce(p, [])) ELSE original END, '~')
              AS final_genres,
              CASE WHEN confidence >= 90 THEN NULL
                   WHEN confidence >= 70 THEN 'Medium confidence (' || printf('%.1f', confidence) || '%) - requires manual review'
                   WHEN confidence >= 40 THEN 'Low confidence (' || printf('%.1f', confidence) || '%) - uncertain match'
                   ELSE 'Very low confidence (' || printf('%.1f', confidence) || '%) - no reliable match found' END
              AS manual_review_reason
       FROM aggregated JOIN joined USING (entity_key) LEFT JOIN more USING (entity_key)""", DECIDED)

add("decision_counts",
    lambda s, d: b.table(s, d, "events").select(F.least("value", F.lit(100.0)).alias("c")).groupBy(
        jb.decision_status(F.col("c")).alias("batch"), mt.review_status(F.col("c")).alias("matcher"),
        mt.review_status(F.col("c"), auto_floor=95.0).alias("automatic")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN c >= 95 THEN 'completed' WHEN c >= 40 THEN 'needs_review' ELSE 'skipped' END AS batch,
              CASE WHEN c >= 40 THEN 'needs_review' ELSE 'skipped' END AS matcher,
              CASE WHEN c >= 95 THEN 'completed' WHEN c >= 40 THEN 'needs_review' ELSE 'skipped' END AS automatic,
              count(*) AS n FROM (SELECT least(value, 100) AS c FROM events) GROUP BY 1, 2, 3""")

add("artist_range",
    lambda s, d: jb.artist_range(b.order_albums(s, d), "d-e").select("album_key"),
    "SELECT album_key FROM order_albums WHERE lower(artist[1:1]) BETWEEN 'd' AND 'e'")

add("specific_album",
    lambda s, d: jb.specific_album(b.part_albums(s, d), "brand#17, RED WIDGET").select("album_key", "track_count"),
    "SELECT album_key, track_count FROM part_albums WHERE artist = 'Brand#17' AND album = 'red widget'")

CAND = {
    **b.lists_sql("order_albums"),
    "checked": """SELECT album_key, count(*) FILTER (genre IN (SELECT genre FROM tax_valid)) AS ok,
                         count(*) FILTER (genre NOT IN (SELECT genre FROM tax_valid)) AS bad FROM norm_list GROUP BY 1""",
    "cand": """SELECT a.album_key, CASE WHEN len(genres) = 0 THEN 'high' WHEN bad > ok THEN 'medium'
                      WHEN bad > 0 THEN 'low' END AS priority
               FROM order_albums a LEFT JOIN checked c ON c.album_key = a.album_key""",
}
add("processing_candidates",
    lambda s, d: jb.processing_candidates(b.order_albums(s, d), b.TAX).select("album_key", "priority"),
    "SELECT album_key, priority FROM cand WHERE priority IS NOT NULL", CAND)

add("candidate_counts",
    lambda s, d: jb.candidate_counts(b.order_albums(s, d), b.TAX),
    "SELECT priority, count(*) AS n_albums FROM cand WHERE priority IS NOT NULL GROUP BY 1", CAND)

add("next_batch",
    lambda s, d: jb.next_batch(jb.processing_candidates(b.order_albums(s, d), b.TAX), 100).select("album_key", "priority"),
    """SELECT album_key, priority FROM cand WHERE priority IS NOT NULL
       ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, album_key LIMIT 100""", CAND)


def event_keys(s, d):
    return b.table(s, d, "events").select(F.col("user_id").cast("string").alias("album_key")).union(
        b.table(s, d, "supplier").select("s_name")).distinct()


add("job_selection",
    lambda s, d: jb.select_for_job(b.user_albums(s, d), event_keys(s, d)).select("album_key", "artist"),
    """SELECT album_key, artist FROM user_albums WHERE album_key IN (SELECT CAST(user_id AS VARCHAR) FROM events)""")

add("job_unknown_keys",
    lambda s, d: jb.unknown_keys(b.user_albums(s, d), event_keys(s, d)),
    """SELECT DISTINCT k AS album_key FROM (SELECT CAST(user_id AS VARCHAR) AS k FROM events UNION ALL
       SELECT s_name FROM supplier) WHERE k NOT IN (SELECT album_key FROM user_albums)""")

COUNTS = {
    "counters": """
        SELECT job_id, count(*) AS processed, count(*) FILTER (status IN ('completed', 'approved')) AS successful,
               count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'needs_review') AS needs_review,
               count(*) FILTER (status = 'skipped') AS skipped,
               count(*) FILTER (created_at > TIMESTAMP '2024-01-20' - INTERVAL 5 MINUTES) AS r5
        FROM job_results GROUP BY 1""",
}
ETA = """CASE WHEN (total_albums - processed) * 2 >= 3600 THEN '~' || ((total_albums - processed) * 2 // 3600) || 'h '
         || ((total_albums - processed) * 2 % 3600 // 60) || 'm remaining'
         ELSE '~' || ((total_albums - processed) * 2 // 60) || 'm remaining' END"""
add("job_summary",
    lambda s, d: jb.job_summary(b.jobs(s, d), b.job_results(s, d), jb.review_queue(b.job_results(s, d))).withColumn(
        "progress_percent", r6("progress_percent")).withColumn("success_rate", r6("success_rate")),
    f"""SELECT j.job_id, total_albums, processed, successful, failed, needs_review, skipped,
               needs_review AS review_queue, round(processed / total_albums * 100, 6) AS progress_percent,
               round(successful / processed * 100, 6) AS success_rate,
               CASE WHEN total_albums <= processed THEN 'Completed' ELSE {ETA} END AS eta
        FROM jobs j JOIN counters c ON c.job_id = j.job_id""", COUNTS)

add("status_counts",
    lambda s, d: jb.status_counts(b.job_results(s, d)),
    "SELECT job_id, status, count(*) AS n FROM job_results GROUP BY 1, 2")

add("confidence_histogram",
    lambda s, d: jb.confidence_histogram(b.job_results(s, d)),
    """SELECT job_id, CASE WHEN confidence >= 90 THEN '90%+' WHEN confidence >= 80 THEN '80-89%'
              WHEN confidence >= 70 THEN '70-79%' WHEN confidence >= 50 THEN '50-69%' ELSE '<50%' END AS bucket,
              count(*) AS n FROM job_results GROUP BY 1, 2""")

add("confidence_deciles",
    lambda s, d: jb.confidence_deciles(b.job_results(s, d)),
    "SELECT CAST(floor(confidence / 10) * 10 AS INTEGER) AS decile, count(*) AS n FROM job_results GROUP BY 1")

add("genre_additions",
    lambda s, d: jb.genre_additions(b.job_results(s, d)),
    """SELECT job_id, count(*) FILTER (len(final_genres) > len(original_genres)) AS albums_with_additions,
              CAST(sum(greatest(0, len(final_genres) - len(original_genres))) AS BIGINT) AS total_additions
       FROM job_results GROUP BY 1""")


def _shown(df):
    return df.select("job_id", "album_key", r6("confidence").alias("confidence"), "status",
                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


SHOWN = """job_id, album_key, round(confidence, 6) AS confidence, status,
           strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS at"""

add("result_page",
    lambda s, d: _shown(jb.result_page(b.job_results(s, d), "job_3", "all", True, 2, 25)),
    f"""SELECT {SHOWN} FROM job_results WHERE job_id = 'job_3' AND len(final_genres) > 1
        ORDER BY job_results.confidence DESC, created_at DESC, album_key LIMIT 25 OFFSET 25""")

add("result_detail",
    lambda s, d: jb.result_detail(b.job_results(s, d), "job_7", "17").select(
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.array_join("diff.added", "~").alias(
            "added"), F.array_join("diff.kept", "~").alias("kept")),
    """SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS at, CASE WHEN len(final_genres) > 1 THEN final_genres[2]
              ELSE '' END AS added, final_genres[1] AS kept
       FROM job_results WHERE job_id = 'job_7' AND album_key = '17'""")

add("review_queue",
    lambda s, d: _shown(jb.open_reviews(jb.review_queue(b.job_results(s, d)), None, 40).withColumn(
        "status", F.lit("needs_review"))),
    f"""SELECT {SHOWN} FROM job_results WHERE status = 'needs_review'
        ORDER BY created_at, job_id, album_key LIMIT 40""")

add("recent_jobs",
    lambda s, d: jb.recent_jobs(b.jobs(s, d), 5).select("job_id", "total_albums"),
    "SELECT job_id, total_albums FROM jobs ORDER BY created_at DESC, job_id LIMIT 5")

add("recent_results",
    lambda s, d: _shown(jb.recent_results(b.job_results(s, d))),
    f"SELECT {SHOWN} FROM job_results ORDER BY created_at DESC, job_id, album_key LIMIT 10")

# --- progress ---------------------------------------------------------------

add("progress_counters",
    lambda s, d: pr.progress_counters(b.job_results(s, d), b.now()),
    f"""SELECT count(*) AS total_processed, count(*) FILTER (status = 'completed' AND files_updated > 0) AS completed,
               count(*) FILTER (confidence >= 75 AND status = 'completed') AS high_confidence,
               count(*) FILTER (confidence < 75 AND confidence >= 50) AS medium_confidence,
               count(*) FILTER (confidence < 50) AS low_confidence,
               count(*) FILTER (created_at > TIMESTAMP '{b.NOW}' - INTERVAL 5 MINUTES) AS last_5_minutes,
               count(*) FILTER (created_at > TIMESTAMP '{b.NOW}' - INTERVAL 1 HOUR) AS last_hour FROM job_results""")

add("relative_times",
    lambda s, d: b.job_results(s, d).select(pr.relative_time(F.col("created_at"), F.lit("2024-02-10").cast("timestamp"))
                                            .alias("ago")).groupBy("ago").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' min ago'
              ELSE ' mins ago' END ELSE (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END END
              AS ago, count(*) AS n
       FROM (SELECT epoch(TIMESTAMP '2024-02-10')::BIGINT - floor(epoch(created_at))::BIGINT AS s FROM job_results)
       GROUP BY 1""")

add("trailing_rate",
    lambda s, d: pr.trailing_rate(b.job_results(s, d), 1800).select(
        "job_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "recent"),
    """SELECT job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS at, count(*) OVER (
              PARTITION BY job_id ORDER BY created_at RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW)
              AS recent FROM job_results""")

add("latest_per_job",
    lambda s, d: _shown(pr.latest_per_job(b.job_results(s, d))),
    f"""SELECT {SHOWN} FROM job_results QUALIFY row_number() OVER (PARTITION BY job_id
        ORDER BY created_at DESC, album_key DESC) = 1""")

add("live_progress",
    lambda s, d: pr.live_progress(b.jobs(s, d), b.job_results(s, d), b.now(), 60).select(
        "job_id", "total_albums", "processed", "recent", "latest_album", r6("progress_percent").alias("pct"),
        "eta_minutes"),
    f"""SELECT j.job_id, total_albums, processed, rc AS recent, la AS latest_album,
               round(processed / total_albums * 100, 6) AS pct,
               CASE WHEN rc > 0 AND total_albums > processed
                    THEN CAST(floor((total_albums - processed) / rc * 60) AS INTEGER) END AS eta_minutes
        FROM jobs j JOIN (SELECT job_id, count(*) AS processed, arg_max(album_key, created_at) AS la,
                                 count(*) FILTER (created_at > TIMESTAMP '{b.NOW}' - INTERVAL 60 MINUTES) AS rc
                          FROM job_results GROUP BY 1) r ON r.job_id = j.job_id""")

# --- registry ---------------------------------------------------------------

add("registry_summary",
    lambda s, d: rg.registry_summary(b.user_registry(s, d)),
    """SELECT 'total' AS dimension, 'all' AS status, count(*) AS n FROM user_registry
       UNION ALL SELECT 'scan_status', coalesce(scan_status, 'unknown'), count(*) FROM user_registry GROUP BY 2
       UNION ALL SELECT 'match_status', coalesce(match_status, 'unknown'), count(*) FROM user_registry GROUP BY 2""")

add("registry_totals",
    lambda s, d: rg.registry_totals(b.user_registry(s, d)).select(
        "total_albums", "high_confidence", F.date_format("last_scan", "yyyy-MM-dd").alias("last_scan"),
        F.date_format("last_match", "yyyy-MM-dd").alias("last_match")),
    """SELECT count(*) AS total_albums, count(*) FILTER (confidence >= 95) AS high_confidence,
              strftime(max(last_scanned), '%Y-%m-%d') AS last_scan, strftime(max(api_match_date), '%Y-%m-%d')
              AS last_match FROM user_registry""")


def updates(s, d):
    return b.job_results(s, d).groupBy("album_key").agg(
        F.max("confidence").alias("confidence"), F.max_by("status", "created_at").alias("match_status"))


add("match_status_update",
    lambda s, d: rg.update_match_status(b.user_registry(s, d), updates(s, d), b.now()).select(
        "album_key", "match_status", r6("confidence").alias("confidence"),
        F.date_format("api_match_date", "yyyy-MM-dd").alias("api_match_date")),
    """SELECT r.album_key, CASE WHEN u.k IS NULL THEN match_status ELSE u.s END AS match_status,
              round(CASE WHEN u.k IS NULL THEN confidence ELSE u.c END, 6) AS confidence,
              CASE WHEN u.k IS NULL THEN strftime(api_match_date, '%Y-%m-%d') ELSE '2024-01-20' END AS api_match_date
       FROM user_registry r LEFT JOIN (SELECT album_key AS k, max(confidence) AS c, arg_max(status, created_at) AS s
                                       FROM job_results GROUP BY 1) u ON u.k = r.album_key""")

add("batch_summary",
    lambda s, d: rg.batch_summary(b.job_results(s, d).withColumn("status", F.nullif("status", F.lit("skipped")))),
    """SELECT CASE status WHEN 'skipped' THEN 'unknown' ELSE status END AS status, count(*) AS n
       FROM job_results GROUP BY 1""")

add("albums_summary",
    lambda s, d: rg.albums_summary(b.order_albums(s, d), b.order_tracks(s, d)),
    """SELECT count(*) AS total_albums, count(*) FILTER (genre <> '') AS albums_with_genres,
              count(*) FILTER (has_artwork) AS albums_with_artwork, (SELECT count(*) FROM lineitem) AS total_tracks
       FROM order_albums""")

add("albums_by_status",
    lambda s, d: rg.albums_by_status(b.user_registry(s, d), "scanned", "matched", 50).select("album_key", "track_count"),
    """SELECT album_key, track_count FROM user_registry WHERE scan_status = 'scanned' AND match_status = 'matched'
       ORDER BY last_scanned DESC, album_key LIMIT 50""")

add("unmatched_albums",
    lambda s, d: rg.unmatched_albums(b.user_registry(s, d), 30).select("album_key", "track_count"),
    """SELECT album_key, track_count FROM user_registry WHERE match_status = 'unmatched'
       ORDER BY last_scanned DESC, album_key LIMIT 30""")

add("recommendations",
    lambda s, d: rg.recommendations(b.user_registry(s, d), b.job_results(s, d), b.order_albums(s, d).withColumn(
        "genres", F.when(F.col("has_artwork"), F.col("genres")).otherwise(
            F.array().cast("array<string>")))),
    """SELECT 'unmatched' AS topic, format('{:,}', count(*)) || ' albums haven''t been matched yet' AS advice
       FROM user_registry WHERE match_status = 'unmatched'
       UNION ALL SELECT 'review', count(*) || ' albums need manual review' FROM job_results WHERE status = 'needs_review'
       UNION ALL SELECT 'coverage', 'Only ' || printf('%.1f', round(count(*) FILTER (has_artwork AND genre <> '')
                 / count(*) * 100, 1)) || '% of albums have genres' FROM order_albums""")


def stored_jobs(s, d):
    """Two jobs over all part albums, one of them run twice under its id, the other without one of the sources."""
    path = scratch_path(s, "jobs")
    bare = materialize(b.part_albums(s, d).withColumn("genres", F.array().cast("array<string>")), "bare")
    for job_id, options in (("all", None), ("all", None), ("few", {"sources": {"discogs": {}}, "confidence_threshold": 50.0})):
        enrich.run_job(bare, b.candidates(s, d), part_votes(s, d), b.TAX, path, job_id, f"job {job_id}", b.now(), options)
    jobs = store.read_log(s, path, "jobs", "job_id").select("job_id", "total_albums", "confidence_threshold")
    results = store.read_log(s, path, "job_results", "job_id").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_distinct("album_key").alias("albums"))
    return jobs.join(results, "job_id")


add("stored_jobs", stored_jobs,
    """SELECT job_id, n AS total_albums, threshold AS confidence_threshold, n AS results, n AS albums
       FROM (SELECT count(*) AS n FROM part_albums),
            (VALUES ('all', 95::double), ('few', 50::double)) t(job_id, threshold)""")
