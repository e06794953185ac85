"""Streams over the event file, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators.albums import fingerprint_text
from shelfmark.session import scratch_path
from shelfmark.streaming import progress as sp
from shelfmark.streaming import registry as sr
from suite import bindings as b

QUERIES = {}


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


def results(s, d):
    """The job results as a stream of files."""
    schema = b.table(s, d, "events").schema

    class Source:  # the binding reads "events" through spark.read; here it is a stream
        class read:
            @staticmethod
            def parquet(path):
                return s.readStream.schema(schema).parquet(path.replace("events.parquet", "events*.parquet"))
    return b.job_results(Source, d)


def run(s, stream, mode, keys=None):
    out = scratch_path(s, "stream")
    sp.run_available(stream, f"{out}/rows", f"{out}/checkpoint", mode)
    return sp.current(s, f"{out}/rows", keys) if keys else s.read.schema(stream.schema).parquet(f"{out}/rows")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


add("stream_job_progress",
    lambda s, d: run(s, sp.job_progress(results(s, d)), "update", ["job_id"]).select(
        "job_id", "processed", "successful", "failed", "needs_review", "skipped", "latest_album",
        stamp("latest_at").alias("latest_at")),
    """SELECT job_id, count(*) AS processed, count(*) FILTER (status IN ('completed', 'approved')) AS successful,
              count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'needs_review') AS needs_review,
              count(*) FILTER (status = 'skipped') AS skipped, arg_max(album_key, created_at) AS latest_album,
              strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest_at FROM job_results GROUP BY 1""")

add("stream_sliding_rate",
    lambda s, d: run(s, sp.sliding_rate(results(s, d)), "update", ["job_id", "window_start"]).select(
        "job_id", stamp("window_start").alias("window_start"), "n"),
    """SELECT job_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n
       FROM (SELECT job_id, unnest(generate_series(date_trunc('minute', created_at) - INTERVAL 4 MINUTES,
                    date_trunc('minute', created_at), INTERVAL 1 MINUTE)) AS w FROM job_results) GROUP BY 1, 2""")

add("stream_hourly_throughput",
    lambda s, d: run(s, sp.hourly_throughput(results(s, d)), "update", ["hour"]).select(
        stamp("hour").alias("hour"), "n", F.round("mean_confidence", 6).alias("mean_confidence")),
    """SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n,
              round(avg(confidence), 6) AS mean_confidence FROM job_results GROUP BY 1""")

add("stream_activity_sessions",
    lambda s, d: run(s, sp.activity_sessions(results(s, d)), "append").select(
        "job_id", stamp("session_start").alias("session_start"), stamp("session_end").alias("session_end"), "n"),
    """SELECT job_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS session_start,
              strftime(max(created_at) + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n
       FROM (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY created_at) AS g
             FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY job_id ORDER BY created_at)
                          < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM job_results))
       GROUP BY job_id, g HAVING max(created_at) + INTERVAL 30 MINUTES
              <= (SELECT max(created_at) - INTERVAL 10 MINUTES FROM job_results)""")

add("stream_first_results",
    lambda s, d: run(s, sp.first_results(results(s, d), "40 days"), "append").select("job_id", "album_key"),
    "SELECT DISTINCT job_id, album_key FROM job_results")

# Results arrive in three deliveries; the second and the third bring the one before them again.
BY_STATUS = ["status IN ('completed', 'approved')", "status = 'needs_review'", "status IN ('failed', 'skipped')"]
BY_DAY = ["dayofmonth(created_at) <= 10", "dayofmonth(created_at) BETWEEN 11 AND 20", "dayofmonth(created_at) > 20"]


def delivered(s, d, parts, columns, start):
    """Write the deliveries one after the other and run a stream over what has arrived after each; the log it appends to."""
    out = scratch_path(s, "deliveries")
    rows = b.job_results(s, d)
    for k, own in enumerate(parts):
        every = rows.where(own)
        if k:
            every = every.unionByName(rows.where(parts[k - 1]))
        every = every.select(*columns)
        every.write.parquet(f"{out}/in/{k}")
        arrived = s.readStream.schema(every.schema).parquet(f"{out}/in/*")
        start(arrived, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return s.read.parquet(f"{out}/log")


ARRIVALS = {
    "arrivals": """
        SELECT r.*, CASE WHEN status IN ('completed', 'approved') THEN 0 WHEN status = 'needs_review' THEN 1 ELSE 2 END AS own
        FROM job_results r""",
    "all_arrivals": "SELECT *, own AS k FROM arrivals UNION ALL SELECT *, own + 1 AS k FROM arrivals WHERE own < 2",
}


def registry_log(s, d):
    path = F.date_format("created_at", "yyyyMMddHHmmssSSSSSS").alias("file_path")
    columns = ["album_key", "artist", "album", path, F.col("created_at").alias("seen_at")]
    return delivered(s, d, BY_STATUS, columns, sr.start_registry)


add("stream_registry",
    lambda s, d: sr.latest(registry_log(s, d), "album_key").select("album_key", "artist", "n_paths", fingerprint_text(
        "n_paths", "hash_hi", "hash_lo").alias("file_hash"), stamp("first_discovered").alias("first_discovered"),
        stamp("last_scanned").alias("last_scanned")),
    """SELECT album_key, artist, n AS n_paths, md5(n || '-' || hi || '-' || lo) AS file_hash, first_discovered, last_scanned
       FROM (SELECT album_key, artist, count(*) AS n, strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS first_discovered,
                    strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS last_scanned,
                    sum(CAST(CAST('0x' || substr(m, 1, 15) AS BIGINT) AS HUGEINT)) AS hi,
                    sum(CAST(CAST('0x' || substr(m, 16, 15) AS BIGINT) AS HUGEINT)) AS lo
             FROM (SELECT DISTINCT album_key, artist, created_at AS seen, md5(strftime(created_at, '%Y%m%d%H%M%S%f')) AS m
                   FROM job_results) GROUP BY 1, 2)""")

add("stream_registry_actions",
    lambda s, d: registry_log(s, d).groupBy("album_key", "action").agg(F.count(F.lit(1)).alias("n"), F.max("n_paths").alias(
        "n_paths")),
    """SELECT album_key, action, count(*) AS n, max(paths) AS n_paths
       FROM (SELECT album_key, k, CASE WHEN k = min(k) OVER (PARTITION BY album_key) THEN 'new'
                                       WHEN fresh > 0 THEN 'updated' ELSE 'same' END AS action,
                    CAST(sum(fresh) OVER (PARTITION BY album_key ORDER BY k) AS BIGINT) AS paths
             FROM (SELECT album_key, k, count(DISTINCT created_at) FILTER (first = k) AS fresh
                   FROM (SELECT *, min(k) OVER (PARTITION BY album_key, created_at) AS first FROM all_arrivals)
                   GROUP BY 1, 2)) GROUP BY 1, 2""", ARRIVALS)


CACHE_HOURS = 72


def cache_log(s, d):
    columns = ["artist", "album", F.lit("source").alias("source"), F.col("suggested_genres").alias("genres"),
               "confidence", F.lit(1.0).alias("weight"), "created_at"]
    return delivered(s, d, BY_DAY, columns, lambda rows, out, checkpoint: sr.start_cache(rows, out, checkpoint, CACHE_HOURS))


add("stream_cache",
    lambda s, d: sr.live_entries(cache_log(s, d)).select(
        "artist", "source", "cache_key", stamp("created_at").alias("created_at"), stamp("expires_at").alias("expires_at")),
    f"""SELECT artist, 'source' AS source, md5(lower(artist) || '|' || lower(album) || '|source') AS cache_key,
               strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS created_at,
               strftime(max(created_at) + INTERVAL {CACHE_HOURS} HOURS, '%Y-%m-%d %H:%M:%S') AS expires_at
        FROM job_results GROUP BY artist, album
        HAVING max(created_at) + INTERVAL {CACHE_HOURS} HOURS > (SELECT max(created_at) FROM job_results)""")
