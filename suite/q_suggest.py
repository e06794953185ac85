"""Artist profiles and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.tags import path_year
from shelfmark.operators import suggest as sg
from shelfmark.refdata import ARTIST_KEYWORDS, COUNTRY_HINTS, ERAS, PATH_KEYWORDS, TITLE_KEYWORDS
from suite import bindings as b

QUERIES = {}


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


def r6(c):
    return F.round(c, 6)


def _list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


LISTS = b.lists_sql("order_albums")
PROFILES = {
    **LISTS,
    "sizes": """SELECT artist, count(*) AS total_albums, count(*) FILTER (len(genres) > 0) AS albums_with_genres
                FROM order_albums GROUP BY 1""",
    "shares": """SELECT a.artist, l.genre, count(*) AS n, count(*) / any_value(albums_with_genres) * 100 AS share
                 FROM norm_list l JOIN order_albums a ON a.album_key = l.album_key JOIN sizes s ON s.artist = a.artist
                 GROUP BY 1, 2""",
    "profile": """
        SELECT s.artist, total_albums, albums_with_genres, coalesce(p, []) AS primary_genres,
               coalesce(q, []) AS secondary_genres, coalesce(n_genres, 0) AS n_genres,
               albums_with_genres / total_albums AS coverage,
               (albums_with_genres / total_albums * 0.7::double
                + CASE WHEN n_genres > 0 THEN len(coalesce(p, [])) / n_genres ELSE 0 END * 0.3::double) * 100 AS confidence
        FROM sizes s LEFT JOIN (
            SELECT artist, count(*) AS n_genres, list(genre ORDER BY n DESC, genre) FILTER (share >= 60) AS p,
                   list(genre ORDER BY n DESC, genre) FILTER (share >= 30 AND share < 60) AS q
            FROM shares GROUP BY 1) x ON x.artist = s.artist""",
}

add("artist_profiles",
    lambda s, d: sg.artist_profiles(b.order_albums(s, d), b.TAX).select(
        "artist", "total_albums", "albums_with_genres", F.array_join("primary_genres", "~").alias("main"),
        F.array_join("secondary_genres", "~").alias("other"), "n_genres", r6("coverage").alias("coverage"),
        r6("confidence").alias("confidence")),
    """SELECT artist, total_albums, albums_with_genres, array_to_string(primary_genres, '~') AS main,
              array_to_string(secondary_genres, '~') AS other, n_genres, round(coverage, 6) AS coverage,
              round(confidence, 6) AS confidence FROM profile""", PROFILES)

SUGGESTED = {
    **PROFILES,
    "by_artist": """
        SELECT artist, list_concat(primary_genres[1:3],
                   CASE WHEN len(primary_genres) < 2 THEN secondary_genres[1:2] ELSE [] END) AS genres, confidence,
               'Based on ' || albums_with_genres || '/' || total_albums || ' albums by this artist. Primary genres: '
               || array_to_string(primary_genres, ', ') AS reasoning
        FROM profile WHERE confidence >= 30 AND len(list_concat(primary_genres[1:3],
                   CASE WHEN len(primary_genres) < 2 THEN secondary_genres[1:2] ELSE [] END)) > 0""",
    "kw": b._values([(i, g, j, w) for i, (g, ws) in enumerate(PATH_KEYWORDS.items()) for j, w in enumerate(ws)],
                    "i, g, j, w"),
    "era": b._values([(s0, e0, gs[0], gs[1]) for s0, e0, gs in ERAS], "y0, y1, g1, g2"),
    "hits": """SELECT album_key, i, g, arg_min(w, j) AS w FROM order_albums JOIN kw
               ON contains(replace(lower(file_path), '/', ' '), w) GROUP BY 1, 2, 3""",
    "path_raw": """
        SELECT album_key, i AS ord, g, '''' || w || ''' found in path' AS reason FROM hits
        UNION ALL SELECT album_key, 100, g1, 'era-based (' || year || ')' FROM order_albums
                  JOIN era ON year BETWEEN y0 AND y1
        UNION ALL SELECT album_key, 101, g2, NULL FROM order_albums JOIN era ON year BETWEEN y0 AND y1""",
    "ctx_kw": b._values([(i, w, g) for i, (w, gs) in enumerate(TITLE_KEYWORDS.items()) for g in gs], "i, w, g"),
    "ctx_raw": f"""
        SELECT album_key, -3 AS ord, unnest(['Compilation', 'Various Artists']) AS g,
               'high track count (' || track_count || ')' AS reason FROM order_albums WHERE track_count >= 15
        UNION ALL SELECT album_key, -2, unnest(['EP', 'Single']), 'short release (' || track_count || ' tracks)'
        FROM order_albums WHERE track_count <= 4
        UNION ALL SELECT album_key, -1, unnest(['Hip Hop', 'Electronic']), 'artist name pattern' FROM order_albums
        WHERE {' OR '.join(f"contains(lower(artist), '{w}')" for w in ARTIST_KEYWORDS)}
        UNION ALL SELECT album_key, i, g, 'album title contains ''' || w || '''' FROM order_albums
        JOIN ctx_kw ON contains(lower(album), w)""",
    "all_raw": """SELECT album_key, 'P' AS kind, ord, g, reason FROM path_raw
                  UNION ALL SELECT album_key, 'C', ord, g, reason FROM ctx_raw""",
    "g_canon_raw": f"SELECT DISTINCT g AS raw, {b.clean_sql('g')} AS cleaned FROM all_raw",
    "g_canon": b.names_sql("x", "y")["canon"].replace("canon_raw", "g_canon_raw"),
    "g_lists": """
        SELECT album_key, kind, min(genre) AS genre
        FROM (SELECT album_key, kind, canonical AS genre FROM all_raw JOIN g_canon ON g = raw WHERE canonical <> ''
              UNION SELECT album_key, kind, parent FROM all_raw JOIN g_canon ON g = raw
                    JOIN tax_parents ON child = canonical)
        GROUP BY album_key, kind, lower(genre)""",
    "g_first3": "SELECT album_key, kind, list_sort(list(genre))[1:3] AS genres FROM g_lists GROUP BY 1, 2",
    "g_why": """SELECT album_key, kind, string_agg(reason, ', ' ORDER BY ord) AS why, count(*) AS n
                FROM (SELECT DISTINCT album_key, kind, ord, reason FROM all_raw WHERE reason IS NOT NULL) GROUP BY 1, 2""",
    "suggested": """
        SELECT album_key, b.genres, confidence, reasoning, 'artist_analysis' AS source, 1 AS ord
        FROM order_albums a JOIN by_artist b ON a.artist = b.artist
        UNION ALL SELECT f.album_key, genres, least(70, 20 * len(genres) + 30)::double, 'Directory analysis: ' || why,
               'directory_analysis', 2 FROM g_first3 f JOIN g_why w ON f.album_key = w.album_key AND f.kind = w.kind
        WHERE f.kind = 'P'
        UNION ALL SELECT f.album_key, genres, least(60, 15 * n + 20)::double, 'Contextual analysis: ' || why,
               'contextual_analysis', 3 FROM g_first3 f JOIN g_why w ON f.album_key = w.album_key AND f.kind = w.kind
        WHERE f.kind = 'C'""",
}

add("all_suggestions",
    lambda s, d: sg.all_suggestions(b.order_albums(s, d), b.TAX).select(
        "album_key", F.array_join("genres", "~").alias("genres"), r6("confidence").alias("confidence"), "reasoning",
        "source"),
    """SELECT album_key, array_to_string(genres, '~') AS genres, round(confidence, 6) AS confidence, reasoning, source
       FROM suggested""", SUGGESTED)

add("path_suggestions",
    lambda s, d: b.order_albums(s, d).select("album_key", sg.path_suggestion("file_path", b.TAX).alias("s")).where(
        "s IS NOT NULL").select("album_key", F.array_join("s.genres", "~").alias("genres"), "s.confidence",
                                "s.reasoning"),
    """SELECT album_key, array_to_string(genres, '~') AS genres, confidence, reasoning FROM suggested
       WHERE source = 'directory_analysis'""", SUGGESTED)

add("context_suggestions",
    lambda s, d: b.order_albums(s, d).select("album_key", sg.context_suggestion(
        "artist", "album", "track_count", b.TAX).alias("s")).where("s IS NOT NULL").select(
        "album_key", F.array_join("s.genres", "~").alias("genres"), "s.confidence", "s.reasoning"),
    """SELECT album_key, array_to_string(genres, '~') AS genres, confidence, reasoning FROM suggested
       WHERE source = 'contextual_analysis'""", SUGGESTED)

add("artist_suggestions",
    lambda s, d: sg.artist_suggestion(b.order_albums(s, d), sg.artist_profiles(b.order_albums(s, d), b.TAX)).where(
        "by_artist IS NOT NULL").select("album_key", F.array_join("by_artist.genres", "~").alias("genres"),
                                        r6("by_artist.confidence").alias("confidence")),
    """SELECT album_key, array_to_string(genres, '~') AS genres, round(confidence, 6) AS confidence FROM suggested
       WHERE source = 'artist_analysis'""", SUGGESTED)

BEST = {
    **SUGGESTED,
    "voiced": """SELECT album_key, g, sum(w) AS w, min(pos) AS pos FROM (
                     SELECT album_key, g, CAST(floor(confidence / 100 * 10) AS BIGINT) AS w, ord * 100 + i AS pos
                     FROM (SELECT album_key, confidence, ord, unnest(genres) AS g, generate_subscripts(genres, 1) AS i
                           FROM suggested)) WHERE w > 0 GROUP BY 1, 2""",
    "top3": """SELECT album_key, list(g ORDER BY w DESC, pos)[1:3] AS genres FROM voiced GROUP BY 1""",
    "means": """SELECT album_key, avg(confidence) AS confidence FROM suggested GROUP BY 1""",
}
add("best_suggestions",
    lambda s, d: sg.best_suggestions(b.order_albums(s, d), b.TAX).select(
        "album_key", F.array_join("genres", "~").alias("genres"), r6("confidence").alias("confidence"), "source"),
    """SELECT t.album_key, array_to_string(genres, '~') AS genres, round(confidence, 6) AS confidence,
              'smart_combined' AS source FROM top3 t JOIN means m ON m.album_key = t.album_key""", BEST)

GAPS = {
    **SUGGESTED,
    "valid_count": """SELECT album_key, count(*) FILTER (genre IN (SELECT genre FROM tax_valid)) AS ok,
                             count(*) FILTER (genre NOT IN (SELECT genre FROM tax_valid)) AS bad
                      FROM norm_list GROUP BY 1""",
    "gap": """SELECT a.album_key, len(a.genres) > 0 AS has_genres,
                     a.album_key IN (SELECT album_key FROM suggested) AS sug, coalesce(bad > ok, false) AS poor
              FROM order_albums a LEFT JOIN valid_count v ON v.album_key = a.album_key""",
}
add("suggestion_gaps",
    lambda s, d: sg.suggestion_gaps(b.order_albums(s, d), b.TAX).withColumn("coverage_percentage",
                                                                            r6("coverage_percentage")),
    """SELECT count(*) AS total_albums, count(*) FILTER (sug) AS albums_with_suggestions,
              count(*) FILTER (sug AND NOT has_genres) AS albums_without_genres,
              count(*) FILTER (sug AND poor) AS albums_with_poor_genres,
              round(count(*) FILTER (sug) / count(*) * 100, 6) AS coverage_percentage FROM gap""", GAPS)

add("suggestion_sources",
    lambda s, d: sg.suggestion_sources(b.order_albums(s, d), b.TAX),
    "SELECT source, count(*) AS n_albums FROM suggested GROUP BY 1", SUGGESTED)

add("suggestion_report",
    lambda s, d: sg.suggestion_report(b.order_albums(s, d), b.TAX).select(
        "kind", "album_key", F.array_join("suggested", "~").alias("suggested")),
    """SELECT * FROM (SELECT 'missing' AS kind, g.album_key, array_to_string(genres, '~') AS suggested
                      FROM gap g LEFT JOIN top3 t ON t.album_key = g.album_key WHERE sug AND NOT has_genres
                      ORDER BY g.album_key LIMIT 20)
       UNION ALL SELECT * FROM (SELECT 'poor', g.album_key, array_to_string(genres, '~')
                      FROM gap g LEFT JOIN top3 t ON t.album_key = g.album_key WHERE sug AND poor
                      ORDER BY g.album_key LIMIT 10)""", {**GAPS, **BEST})

add("path_years",
    lambda s, d: b.order_albums(s, d).select("album_key", path_year("file_path").alias("y")),
    r"""SELECT album_key, CAST(nullif(regexp_extract(file_path, '\b(19[5-9]\d|20[0-4]\d)\b', 1), '') AS INTEGER) AS y
        FROM order_albums""")

add("path_keywords",
    lambda s, d: b.order_albums(s, d).select("album_key", F.explode(sg.keyword_hits("file_path")).alias("h")).select(
        "album_key", "h.genre", "h.keyword"),
    "SELECT album_key, g AS genre, w AS keyword FROM hits", SUGGESTED)

add("era_lookup",
    lambda s, d: sg.with_era(b.part_albums(s, d), "year").select("album_key", "year", "era_start", F.array_join(
        "era_genres", "~").alias("era_genres")),
    f"""SELECT album_key, year, e.a AS era_start, array_to_string(e.g, '~') AS era_genres FROM part_albums
        LEFT JOIN (VALUES {', '.join(f'({a}, {z}, {_list(g)})' for a, z, g in ERAS)}) e(a, z, g)
               ON year BETWEEN e.a AND e.z""")

HINTS = sorted(COUNTRY_HINTS)


def _countries(s, d):
    names = F.array(*[F.lit(c.title()) for c in HINTS])
    return b.table(s, d, "customer").select("c_custkey", F.coalesce(
        F.get(names, F.col("c_nationkey")), F.lit("Elsewhere")).alias("country"))


add("country_hints",
    lambda s, d: sg.hint_suggestions(_countries(s, d), "country", "country").select(
        "c_custkey", "country", F.array_join("hint_genres", "~").alias("hints")),
    f"""SELECT c_custkey, coalesce({_list([c.title() for c in HINTS])}[c_nationkey + 1], 'Elsewhere') AS country,
               array_to_string(g, '~') AS hints
        FROM customer LEFT JOIN (VALUES {', '.join(f"({i}, {_list(COUNTRY_HINTS[c])})" for i, c in enumerate(HINTS))})
             h(i, g) ON h.i = c_nationkey""")
