"""Scans, track attributes, albums, library statistics, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import tags as tg
from shelfmark.operators import albums as al
from shelfmark.operators import registry as rg
from shelfmark.plans import register as plan_register
from shelfmark.sources import store
from suite import bindings as b

QUERIES = {}


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


def r6(c):
    return F.round(c, 6)


TAGGED = {
    "tagged": f"""
        SELECT {b._PATH} AS file_path, l_linenumber AS track_number, p_name AS title, s_name AS artist,
               CASE WHEN l_tax = 0 THEN '' ELSE p_brand END AS album,
               o_orderstatus = 'P' AND l_returnflag <> 'R' AS is_compilation,
               CASE WHEN l_linestatus <> 'O' AND o_orderstatus = 'P' AND l_returnflag <> 'R' THEN 'Various Artists'
                    ELSE s_name END AS album_artist,
               {b._case('p_type', b.GENRE_OF_TYPE)} AS genre, CAST(year(o_orderdate) AS INTEGER) AS year,
               l_quantity AS duration, lower({b._case('l_returnflag', b.EXT_OF_FLAG)}) AS file_format,
               l_orderkey AS file_size
        FROM lines JOIN orders ON l_orderkey = o_orderkey""",
    "keyed": """
        SELECT *, CASE WHEN is_compilation THEN 'Various Artists' ELSE album_artist END || '|' || album AS album_key,
               CASE WHEN is_compilation THEN 'Various Artists' ELSE album_artist END AS shown
        FROM tagged""",
}

add("track_attributes",
    lambda s, d: al.extract_tracks(b.tag_bags(s, d)).drop("raw_metadata"),
    """SELECT album_key, track_number, title, artist, album, album_artist, genre, year, is_compilation, duration,
              file_path, file_format, file_size FROM keyed""", TAGGED)

add("valid_tracks",
    lambda s, d: al.valid_tracks(al.extract_tracks(b.tag_bags(s, d))).groupBy("file_format", "is_compilation").agg(
        F.count(F.lit(1)).alias("n_tracks"), F.count_distinct("album_key").alias("n_albums")),
    """SELECT file_format, is_compilation, count(*) AS n_tracks, count(DISTINCT album_key) AS n_albums
       FROM keyed WHERE album <> '' GROUP BY 1, 2""", TAGGED)

add("first_tag",
    lambda s, d: b.tag_bags(s, d).select("file_path", tg.first_tag("tags", ["TPE2", "ALBUMARTIST", "TPE1"])
                                         .alias("value")),
    f"""SELECT {b._PATH} AS file_path, CASE l_returnflag WHEN 'R' THEN ''
               WHEN 'N' THEN s_name ELSE CASE WHEN l_linestatus = 'O' THEN s_name ELSE '' END END AS value
        FROM lines JOIN orders ON l_orderkey = o_orderkey""")

add("raw_metadata",
    lambda s, d: al.extract_tracks(b.tag_bags(s, d)).select(
        "file_path", F.get_json_object("raw_metadata", "$.format").alias("format"),
        F.get_json_object("raw_metadata", "$.technical.bitrate").cast("int").alias("bitrate"),
        F.get_json_object("raw_metadata", "$.tags.TITLE[0]").alias("vorbis_title")),
    """SELECT file_path, upper(file_format) AS format, CAST(320 AS INTEGER) AS bitrate,
              CASE WHEN file_format = 'flac' THEN title END AS vorbis_title FROM tagged""", TAGGED)

add("tracks_to_albums",
    lambda s, d: al.tracks_to_albums(al.valid_tracks(al.extract_tracks(b.tag_bags(s, d)))).select(
        "album_key", "artist", "album", "year", F.array_join("genres", ";;").alias("genres"), "track_count",
        "total_duration", "file_path", "is_compilation"),
    """SELECT album_key, arg_min(shown, file_path) AS artist, arg_min(album, file_path) AS album,
              arg_min(year, file_path) AS year, array_to_string(list_sort(list(DISTINCT genre)), ';;') AS genres,
              count(*) AS track_count, sum(duration) AS total_duration, min(file_path) AS file_path,
              arg_min(is_compilation, file_path) AS is_compilation
       FROM keyed WHERE album <> '' GROUP BY album_key""", TAGGED)

add("library_stats",
    lambda s, d: al.library_stats(b.order_albums(s, d)).withColumn("genre_coverage", r6("genre_coverage")),
    """SELECT count(*) AS total_albums, CAST(sum(track_count) AS BIGINT) AS total_tracks,
              count(*) FILTER (len(genres) > 0) AS albums_with_genres,
              (SELECT count(DISTINCT g) FROM (SELECT unnest(genres) AS g FROM order_albums)) AS unique_genres,
              round(count(*) FILTER (len(genres) > 0) / count(*) * 100, 6) AS genre_coverage
       FROM order_albums""")

add("genre_distribution",
    lambda s, d: al.genre_distribution(b.part_albums(s, d)),
    "SELECT g AS genre, count(*) AS n_albums FROM (SELECT unnest(genres) AS g FROM part_albums) GROUP BY 1")

add("genre_top10",
    lambda s, d: al.genre_distribution(b.order_albums(s, d), 10),
    """SELECT g AS genre, count(*) AS n_albums FROM (SELECT unnest(genres) AS g FROM order_albums) GROUP BY 1
       ORDER BY n_albums DESC, genre LIMIT 10""")

add("album_totals",
    lambda s, d: al.album_totals(b.order_tracks(s, d)),
    """SELECT album_key, count(*) AS track_count, coalesce(sum(duration), 0) AS total_duration
       FROM order_tracks GROUP BY 1""")

add("album_genres_long",
    lambda s, d: al.album_genres(b.order_tracks(s, d)),
    "SELECT DISTINCT album_key, genre FROM order_tracks")

add("album_tracks",
    lambda s, d: al.album_tracks(b.order_tracks(s, d), b.rough_albums(s, d)),
    """SELECT t.album_key, track_number, title, t.artist AS track_artist, duration, file_path, a.artist, a.album
       FROM order_tracks t JOIN rough_albums a ON t.album_key = a.album_key""")

add("file_inventory",
    lambda s, d: al.file_inventory(b.files(s, d)),
    """SELECT lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) AS ext,
              CASE WHEN ends_with(file_path, '.m3u') THEN 'playlist' ELSE 'media' END AS class, count(*) AS n_files,
              count(*) FILTER (ends_with(file_path, '.m3u')) AS n_removable
       FROM order_tracks GROUP BY 1, 2""")

add("audio_files",
    lambda s, d: al.scan_tracks(b.files(s, d)).groupBy(tg.parent_directory("file_path").alias("folder")).agg(
        F.count(F.lit(1)).alias("n")),
    """SELECT regexp_extract(file_path, '^(.*)/', 1) AS folder, count(*) AS n FROM order_tracks
       WHERE NOT ends_with(file_path, '.m3u') GROUP BY 1""")

add("path_parts",
    lambda s, d: b.files(s, d).select("file_path", tg.file_format("file_path").alias("file_format"),
                                      tg.parent_directory("file_path").alias("folder"), "album_key"),
    """SELECT file_path, lower(split_part(file_path, '.', 2)) AS file_format,
              regexp_extract(file_path, '^(.*)/', 1) AS folder, album_key FROM order_tracks""")

add("directory_names",
    lambda s, d: b.order_albums(s, d).select(
        "album_key", tg.parse_directory(F.concat("artist", F.lit(" - "), "album", F.lit(" ("),
                                                 F.col("year").cast("string"), F.lit(") [FLAC]"))).alias("p"))
    .select("album_key", F.col("p.artist").alias("parsed_artist"), F.col("p.album").alias("parsed_album")),
    "SELECT album_key, artist AS parsed_artist, album AS parsed_album FROM order_albums")

add("album_paths",
    lambda s, d: b.order_tracks(s, d).groupBy("album_key").agg(
        F.collect_list(F.struct("file_path", "title")).alias("tracks")).select(
        "album_key", F.size(tg.track_paths("tracks")).alias("n_paths"),
        tg.paths_hash(tg.track_paths("tracks")).alias("file_hash")),
    """SELECT album_key, CAST(count(*) AS INTEGER) AS n_paths,
              md5(string_agg(file_path, '|' ORDER BY file_path)) AS file_hash FROM order_tracks GROUP BY 1""")

FINGERPRINT = {
    "prints": """
        SELECT album_key, count(*) AS track_count,
               sum(CAST(CAST('0x' || substr(md5(file_path), 1, 15) AS BIGINT) AS HUGEINT)) AS hi,
               sum(CAST(CAST('0x' || substr(md5(file_path), 16, 15) AS BIGINT) AS HUGEINT)) AS lo
        FROM order_tracks GROUP BY 1""",
}
add("album_fingerprints",
    lambda s, d: al.album_paths_hash(b.order_tracks(s, d)),
    "SELECT album_key, track_count, md5(track_count || '-' || hi || '-' || lo) AS file_hash FROM prints", FINGERPRINT)

add("cache_keys",
    lambda s, d: b.cache_rows(s, d).select(tg.cache_key("artist", "album", "source").alias("cache_key")).distinct(),
    "SELECT DISTINCT md5(lower(artist) || '|' || lower(album) || '|' || source) AS cache_key FROM cache_rows")


# compilations: supplier and part as (artist, title); orders in status P are tagged
def _supplier_albums(s, d):
    t = al.valid_tracks(al.extract_tracks(b.tag_bags(s, d))).select(
        F.concat_ws("|", "artist", "title").alias("album_key"), "artist", F.col("title").alias("album"), "duration",
        "file_path", "is_compilation")
    # the key follows from the names; a boolean is aggregated without sorting the rows
    albums = t.groupBy("artist", "album").agg(
        F.count(F.lit(1)).alias("track_count"), F.sum("duration").alias("total_duration"),
        F.max("is_compilation").cast("string").alias("tag")).withColumn("album_key", F.concat_ws("|", "artist", "album"))
    return albums, t.select("album_key", "file_path", "duration")


COMPILATION = {
    **TAGGED,
    "valid": "SELECT artist || '|' || title AS album_key, * FROM tagged WHERE album <> ''",
    "made": """SELECT album_key, artist, title AS album, count(*) AS track_count, sum(duration) AS total_duration,
                      bool_or(is_compilation) AS flagged FROM valid GROUP BY 1, 2, 3""",
    "groups": "SELECT album, min(album_key) AS master, count(*) AS entries FROM made WHERE flagged GROUP BY 1",
    "moves": """SELECT m.album_key, master FROM made m JOIN groups g ON m.album = g.album
                WHERE flagged AND entries > 1""",
    "placed": """SELECT coalesce(master, v.album_key) AS album_key, duration, master IS NOT NULL AS merged,
                        coalesce(master <> v.album_key, false) AS moved
                 FROM valid v LEFT JOIN moves m ON v.album_key = m.album_key""",
}
add("compilation_albums",
    lambda s, d: al.consolidate_compilations(*_supplier_albums(s, d), "tag")[0].select(
        "album_key", "artist", "album", "track_count", "total_duration"),
    """SELECT m.album_key, CASE WHEN k.master IS NOT NULL THEN 'Various Artists' ELSE artist END AS artist, album,
              CASE WHEN k.master IS NOT NULL THEN p.n ELSE track_count END AS track_count,
              CASE WHEN k.master IS NOT NULL THEN p.d ELSE total_duration END AS total_duration
       FROM made m LEFT JOIN moves k ON m.album_key = k.album_key
       LEFT JOIN (SELECT album_key, count(*) AS n, sum(duration) AS d FROM placed GROUP BY 1) p
              ON p.album_key = m.album_key
       WHERE k.master IS NULL OR k.master = m.album_key""", COMPILATION)

add("compilation_counters",
    lambda s, d: al.consolidate_compilations(*_supplier_albums(s, d), "tag")[2],
    """SELECT (SELECT CAST(sum(entries) AS BIGINT) FROM groups) AS compilations_found,
              (SELECT CAST(sum(entries - 1) AS BIGINT) FROM groups WHERE entries > 1) AS albums_consolidated,
              count(*) FILTER (moved) AS tracks_moved, count(*) FILTER (merged) AS master_tracks
       FROM placed""", COMPILATION)

# --- stores: an older and a newer scan of the same files ---------------------

SCANS = {
    "old_t": f"SELECT * FROM order_tracks WHERE shipped < TIMESTAMP '{b.OLD_SCAN_BEFORE}'",
    "new_t": f"SELECT * FROM order_tracks WHERE shipped >= TIMESTAMP '{b.NEW_SCAN_SINCE}'",
    "old_a": "SELECT album_key, count(*) AS track_count, sum(duration) AS total_duration FROM old_t GROUP BY 1",
    "new_a": "SELECT album_key, count(*) AS track_count, sum(duration) AS total_duration FROM new_t GROUP BY 1",
    "old_h": "SELECT album_key, count(*) AS n, md5(string_agg(file_path, '|' ORDER BY file_path)) AS h FROM old_t GROUP BY 1",
    "new_h": "SELECT album_key, count(*) AS n, md5(string_agg(file_path, '|' ORDER BY file_path)) AS h FROM new_t GROUP BY 1",
    "merged": """
        SELECT coalesce(o.album_key, n.album_key) AS album_key,
               CASE WHEN o.album_key IS NULL THEN 'new' WHEN n.album_key IS NULL THEN 'absent'
                    WHEN o.h <> n.h THEN 'updated' ELSE 'same' END AS action,
               CASE WHEN n.album_key IS NULL OR o.h = n.h THEN o.n ELSE n.n END AS track_count,
               CASE WHEN o.album_key IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END
                   AS first_discovered,
               CASE WHEN n.album_key IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS last_scanned
        FROM old_h o FULL JOIN new_h n ON o.album_key = n.album_key""",
}


def old_tracks(s, d):
    return b.shipped_tracks(s, d, before=b.OLD_SCAN_BEFORE)


def new_tracks(s, d):
    return b.shipped_tracks(s, d, since=b.NEW_SCAN_SINCE)


def _scanned(tracks):
    return al.album_paths_hash(tracks).select(
        "album_key", F.lit("").alias("artist"), F.lit("").alias("album"), "track_count", "file_hash")


def merged_registry(s, d):
    first, second = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    empty = s.createDataFrame([], b.schemas_registry())
    registry = rg.registry_merge(empty, _scanned(old_tracks(s, d)), first).drop("action")
    return rg.registry_merge(registry, _scanned(new_tracks(s, d)), second)


add("registry_merge",
    lambda s, d: merged_registry(s, d).select(
        "album_key", "action", "track_count", F.date_format("first_discovered", "yyyy-MM-dd").alias("first_discovered"),
        F.date_format("last_scanned", "yyyy-MM-dd").alias("last_scanned")),
    """SELECT album_key, action, track_count, strftime(first_discovered, '%Y-%m-%d') AS first_discovered,
              strftime(last_scanned, '%Y-%m-%d') AS last_scanned FROM merged""", SCANS)

add("registry_merge_counters",
    lambda s, d: rg.merge_counters(merged_registry(s, d)),
    """SELECT count(*) FILTER (action = 'new') AS discovered, count(*) FILTER (action = 'updated') AS updated,
              count(*) FILTER (action <> 'absent') AS scanned, count(*) AS registered FROM merged""", SCANS)

add("scan_and_register",
    lambda s, d: rg.merge_counters(plan_register.register(
        b.tag_bags(s, d), s.createDataFrame([], b.schemas_registry()), b.now())),
    """SELECT count(DISTINCT album_key) AS discovered, CAST(0 AS BIGINT) AS updated,
              count(DISTINCT album_key) AS scanned, count(DISTINCT album_key) AS registered
       FROM keyed WHERE album <> ''""", TAGGED)


def _upserted(s, d):
    old, new = old_tracks(s, d), new_tracks(s, d)
    return store.upsert_albums(al.album_totals(old), old, al.album_totals(new), new)


add("store_upsert_albums",
    lambda s, d: _upserted(s, d)[0],
    """SELECT coalesce(n.album_key, o.album_key) AS album_key, coalesce(n.track_count, o.track_count) AS track_count,
              coalesce(n.total_duration, o.total_duration) AS total_duration
       FROM old_a o FULL JOIN new_a n ON o.album_key = n.album_key""", SCANS)

add("store_upsert_tracks",
    lambda s, d: _upserted(s, d)[1].select("album_key", "file_path"),
    """SELECT album_key, file_path FROM new_t UNION ALL
       SELECT album_key, file_path FROM old_t WHERE album_key NOT IN (SELECT album_key FROM new_t)""", SCANS)


def _large_orders(s, d):
    return b.table(s, d, "orders").where("o_totalprice > 400000").select(
        F.col("o_orderkey").cast("string").alias("album_key"))


add("partial_rescan",
    lambda s, d: store.refresh_albums(al.album_totals(old_tracks(s, d)), old_tracks(s, d),
                                      al.album_totals(new_tracks(s, d)), new_tracks(s, d), _large_orders(s, d))[0],
    """SELECT coalesce(n.album_key, o.album_key) AS album_key, coalesce(n.track_count, o.track_count) AS track_count,
              coalesce(n.total_duration, o.total_duration) AS total_duration
       FROM old_a o FULL JOIN (SELECT * FROM new_a WHERE album_key IN (
            SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice > 400000)) n
         ON o.album_key = n.album_key""", SCANS)

add("rescan_failed",
    lambda s, d: store.refresh_failed(
        b.rough_albums(s, d), b.files(s, d),
        b.rough_albums(s, d).select("album_key", F.when(F.col("artist").isNull(), "no artist").alias("error_message")),
        b.rough_albums(s, d), b.files(s, d))[2],
    """SELECT count(*) AS checked, count(*) FILTER (coalesce(artist, '') <> '' OR coalesce(album, '') <> '') AS fixed,
              count(*) FILTER (coalesce(artist, '') = '' AND coalesce(album, '') = '') AS still_failed
       FROM rough_albums WHERE artist IS NULL""")

add("albums_across_stores",
    lambda s, d: b.rough_albums(s, d).join(al.album_totals(b.order_tracks(s, d)), "album_key", "left").groupBy(
        F.col("track_count").isNull().alias("no_tracks")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT t.album_key IS NULL AS no_tracks, count(*) AS n FROM rough_albums a
       LEFT JOIN (SELECT DISTINCT album_key FROM order_tracks) t ON a.album_key = t.album_key GROUP BY 1""")
