"""Versions, approvals, rejections, reverts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import history as hs
from shelfmark.operators.common import latest
from shelfmark.operators.ordered import numbered, with_previous
from suite import bindings as b

QUERIES = {}
FIELDS = ["genre", "album"]


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


def logged(s, d):
    return hs.versions_of(b.order_log(s, d), "album_key", "created_at", ["change_id"], FIELDS)


LOG = {
    "logged": """
        SELECT *, row_number() OVER w AS v, lag(genre) OVER w AS g0, lag(album) OVER w AS a0,
               row_number() OVER (PARTITION BY album_key ORDER BY created_at DESC, change_id DESC) = 1 AS is_current
        FROM order_log WINDOW w AS (PARTITION BY album_key ORDER BY created_at, change_id)""",
}

add("version_numbers",
    lambda s, d: numbered(b.order_log(s, d), "album_key", "created_at", ["change_id"], "v").select(
        "album_key", "change_id", "v"),
    "SELECT album_key, change_id, v FROM logged", LOG)

add("previous_state",
    lambda s, d: with_previous(b.order_log(s, d), "album_key", "created_at", ["change_id"], "genre", "before").select("change_id", "before"),
    "SELECT change_id, g0 AS before FROM logged", LOG)

add("changed_fields",
    lambda s, d: logged(s, d).select("album_key", "version_number", F.explode(F.map_entries("changed_fields")).alias(
        "e")).select("album_key", "version_number", F.col("e.key").alias("field"), F.col("e.value.old").alias("old"),
                     F.col("e.value.new").alias("new")),
    """SELECT album_key, v AS version_number, 'genre' AS field, g0 AS old, genre AS new FROM logged
       WHERE v > 1 AND g0 <> genre
       UNION ALL SELECT album_key, v, 'album', a0, album FROM logged WHERE v > 1 AND a0 <> album""", LOG)

add("current_versions",
    lambda s, d: logged(s, d).where("is_current").select("album_key", "version_number", "genre", "album"),
    "SELECT album_key, v AS version_number, genre, album FROM logged WHERE is_current", LOG)

add("latest_result",
    lambda s, d: latest(b.job_results(s, d), ["album_key"], ["created_at", "job_id"], ["status", "confidence"]).select(
        "album_key", "status", F.round("confidence", 6).alias("confidence")),
    """SELECT album_key, status, round(confidence, 6) AS confidence FROM job_results
       QUALIFY row_number() OVER (PARTITION BY album_key ORDER BY created_at DESC) = 1""")


def stored(s, d):
    """Version table made of the order log."""
    v = logged(s, d)
    return v.select(
        "album_key", "version_number", F.struct(
            F.concat(F.lit("user "), "album_key").alias("artist"), F.col("album"), F.lit(2000).alias("year"),
            F.col("genre"), F.lit(10).cast("bigint").alias("track_count"), F.lit(1.0).alias("total_duration"),
            F.lit("-").alias("file_path")).alias("snapshot"),
        "changed_fields", F.lit("scan").alias("changed_by"), F.lit("").alias("change_reason"), "created_at",
        "is_current", F.lit(None).cast("bigint").alias("reverted_from"))


def approvals(s, d):
    """Albums whose last event was a purchase, each named twice."""
    return latest(b.job_results(s, d), ["album_key"], ["created_at"], ["status"]).where("status = 'approved'").select(
        "album_key").select(
        F.explode(F.array("album_key", "album_key")).alias("album_key"))


APPROVED = {
    **LOG,
    "okay": """SELECT album_key FROM (SELECT album_key, arg_max(status, created_at) AS s FROM job_results GROUP BY 1)
               WHERE s = 'approved'""",
    "chosen": """SELECT * FROM job_results WHERE status = 'needs_review' AND album_key IN (SELECT album_key FROM okay)
                 QUALIFY row_number() OVER (PARTITION BY album_key ORDER BY created_at DESC, job_id DESC) = 1""",
    "last_v": "SELECT album_key, max(v) AS last FROM logged GROUP BY 1",
}


def approved(s, d):
    return hs.apply_approvals(b.user_albums(s, d), b.job_results(s, d), approvals(s, d), stored(s, d), b.now())


add("approved_albums",
    lambda s, d: approved(s, d)[0].select("album_key", "artist", "album", "genre"),
    """SELECT a.album_key, CASE WHEN c.album_key IS NULL THEN a.artist ELSE 'User #' || a.album_key END AS artist,
              a.album, CASE WHEN c.album_key IS NULL THEN a.genre ELSE array_to_string(c.suggested_genres, '; ') END
              AS genre
       FROM user_albums a LEFT JOIN chosen c ON c.album_key = a.album_key""", APPROVED)

add("approved_results",
    lambda s, d: approved(s, d)[1].groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN status = 'needs_review' AND album_key IN (
                        SELECT c.album_key FROM chosen c JOIN user_albums a ON a.album_key = c.album_key) THEN 'approved'
              ELSE status END AS status, count(*) AS n FROM job_results GROUP BY 1""", APPROVED)

add("approved_versions",
    lambda s, d: approved(s, d)[2].select(
        "album_key", "version_number", F.col("snapshot.artist").alias("artist"), F.col("snapshot.genre").alias("genre"),
        F.array_join(F.array_sort(F.map_keys("changed_fields")), ",").alias("changed"), "changed_by", "is_current"),
    """SELECT c.album_key, coalesce(last, 0) + 1 AS version_number, 'User #' || c.album_key AS artist,
              array_to_string(c.suggested_genres, '; ') AS genre, 'artist,genre' AS changed, 'api_match' AS changed_by,
              true AS is_current
       FROM chosen c JOIN user_albums a ON a.album_key = c.album_key LEFT JOIN last_v l ON l.album_key = c.album_key
       UNION ALL
       SELECT c.album_key, 0, a.artist, a.genre, NULL, 'preserved', false
       FROM chosen c JOIN user_albums a ON a.album_key = c.album_key LEFT JOIN last_v l ON l.album_key = c.album_key
       WHERE last IS NULL""", APPROVED)

add("rejected_results",
    lambda s, d: hs.apply_rejections(b.job_results(s, d), approvals(s, d)).groupBy("job_id", "status").agg(
        F.count(F.lit(1)).alias("n")),
    """SELECT job_id, CASE WHEN status = 'needs_review' AND album_key IN (SELECT album_key FROM okay) THEN 'rejected'
              ELSE status END AS status, count(*) AS n FROM job_results GROUP BY 1, 2""", APPROVED)

add("appended_versions",
    lambda s, d: hs.append_versions(stored(s, d), approved(s, d)[2]).where("is_current").select(
        "album_key", "version_number", "changed_by"),
    """SELECT album_key, v AS version_number, 'scan' AS changed_by FROM logged
       WHERE is_current AND album_key NOT IN (SELECT album_key FROM chosen)
       UNION ALL SELECT c.album_key, coalesce(last, 0) + 1, 'api_match'
       FROM chosen c JOIN user_albums a ON a.album_key = c.album_key LEFT JOIN last_v l ON l.album_key = c.album_key""",
    APPROVED)

add("next_version_numbers",
    lambda s, d: hs.next_version_numbers(stored(s, d), b.user_albums(s, d)),
    """SELECT a.album_key, coalesce(last, 0) + 1 AS next_version FROM user_albums a
       LEFT JOIN last_v l ON l.album_key = a.album_key""", APPROVED)


def older(s, d):
    """Old version table: the customers themselves."""
    return b.user_albums(s, d).select("album_key", F.lit(1).cast("bigint").alias("version_number"), "artist", "album",
                                      "year", "genre", F.lit("import").alias("changed_by"),
                                      F.lit(True).alias("is_current"))


add("version_history",
    lambda s, d: hs.version_history(stored(s, d), older(s, d)).select(
        "album_key", "version_number", "artist", "genre", "changed_by", "is_current"),
    """SELECT album_key, v AS version_number, 'user ' || album_key AS artist, genre, 'scan' AS changed_by, is_current
       FROM logged
       UNION ALL SELECT album_key, 1, artist, genre, 'import', true FROM user_albums
       WHERE album_key NOT IN (SELECT album_key FROM order_log)""", LOG)

add("album_history",
    lambda s, d: hs.version_history(stored(s, d), None, "17").select("version_number", "album", "genre"),
    "SELECT v AS version_number, album, genre FROM logged WHERE album_key = '17'", LOG)


def reverted(s, d):
    """Every album with at least three versions goes back to its second; a request for the first loses."""
    v = stored(s, d)
    requests = v.groupBy("album_key").agg(F.max("version_number").alias("m")).where("m >= 3").select(
        "album_key", F.explode(F.expr("array(1L, 2L, 2L)")).alias("version_number"))
    return hs.revert(b.user_albums(s, d), v, requests, b.now())


add("reverted_albums",
    lambda s, d: reverted(s, d)[0].select("album_key", "artist", "album", "year", "genre"),
    """SELECT a.album_key, a.artist, coalesce(l.album, a.album) AS album,
              CASE WHEN l.album_key IS NULL THEN a.year ELSE 2000 END AS year, coalesce(l.genre, a.genre) AS genre
       FROM user_albums a LEFT JOIN (SELECT * FROM logged WHERE v = 2 AND album_key IN (
            SELECT album_key FROM last_v WHERE last >= 3)) l ON l.album_key = a.album_key""", APPROVED)

add("reverted_versions",
    lambda s, d: reverted(s, d)[1].select("album_key", "version_number", F.col("snapshot.genre").alias("genre"),
                                          "change_reason", "is_current", "reverted_from"),
    """SELECT a.album_key, last + 1 AS version_number, a.genre, 'State before revert' AS change_reason,
              false AS is_current, CAST(NULL AS BIGINT) AS reverted_from
       FROM user_albums a JOIN last_v l ON l.album_key = a.album_key WHERE last >= 3
       UNION ALL SELECT l.album_key, last + 2, genre, 'Reverted to version 2', true, 2
       FROM logged l JOIN last_v x ON x.album_key = l.album_key
       WHERE v = 2 AND last >= 3 AND l.album_key IN (SELECT album_key FROM user_albums)""", APPROVED)

add("proposed_changes",
    lambda s, d: hs.proposed_changes(b.user_albums(s, d), b.job_results(s, d)).select(
        "album_key", "artist", "status", F.array_join("suggested_genres", "~").alias("suggested"), "corrected_artist",
        "has_proposal"),
    """SELECT a.album_key, a.artist, status, array_to_string(suggested_genres, '~') AS suggested,
              CASE WHEN status = 'needs_review' THEN 'User #' || a.album_key END AS corrected_artist,
              r.album_key IS NOT NULL AS has_proposal
       FROM user_albums a LEFT JOIN (SELECT * FROM job_results QUALIFY row_number() OVER (
            PARTITION BY album_key ORDER BY created_at DESC) = 1) r ON r.album_key = a.album_key""")
