"""Quality rules, scores, reports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from shelfmark.operators import quality as ql
from shelfmark.plans.quality_report import run_report
from shelfmark.session import scratch_path
from shelfmark.sources import store
from suite import bindings as b
from suite.q_matching import lev

QUERIES = {}
C = "issue_type, severity, album_key, artist, album, description, suggested_fix, confidence"


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


def r6(c):
    return F.round(c, 6)


def issue(kind, severity, description, fix, where, confidence="100::double", source="used"):
    return f"""SELECT '{kind}' AS issue_type, '{severity}' AS severity, album_key, artist, album,
                      {description} AS description, {fix} AS suggested_fix, {confidence} AS confidence
               FROM {source} WHERE {where}"""


def lit(s):
    return "'" + s.replace("'", "''") + "'"


WORDS = r"string_split_regex(lower(trim(genre)), '\s+')"
GENRE_SQL = " UNION ALL ".join([
    issue("empty_genre", "warning", lit("Empty or whitespace-only genre"),
          lit("Remove empty genre or replace with valid genre"), "trim(genre) = ''"),
    issue("invalid_characters", "warning", "'Genre contains invalid characters: \"' || genre || '\"'",
          lit("Remove special characters and normalize"), r"regexp_matches(genre, '[^\w\s\-&/().]')"),
    issue("too_long", "info", "'Genre name is very long (' || length(genre) || ' chars): \"' || genre[1:30] || '...\"'",
          lit("Use shorter, more standard genre name"), "length(genre) > 50"),
    issue("numeric_only", "critical", "'Genre is numeric only: \"' || genre || '\"'",
          lit("Replace with proper genre name"), r"regexp_full_match(trim(genre), '\d+')"),
    issue("duplicate_words", "info", "'Genre has duplicate words: \"' || genre || '\"'", lit("Remove duplicate words"),
          f"len({WORDS}) <> len(list_distinct({WORDS}))"),
    issue("invalid_format", "warning", "'Genre has formatting issues: \"' || genre || '\"'",
          lit("Clean up spacing and punctuation"), r"regexp_matches(genre, '/{2,}|&{2,}|\s{3,}')"),
    issue("unknown_genre", "info", "'Unknown genre: \"' || genre || '\"'",
          """'Consider mapping to: ' || coalesce((SELECT string_agg(g.genre, ', ' ORDER BY g.genre) FROM (
                 SELECT v.genre FROM tax_valid v WHERE contains(lower(v.genre), lower(used.genre))
                 ORDER BY v.genre LIMIT 3) g), '')""",
          "genre IN (SELECT raw FROM canon WHERE canonical NOT IN (SELECT genre FROM tax_valid))", "50::double"),
])
USED = {
    "used": "SELECT album_key, artist, album, genre FROM order_albums WHERE genre <> ''",
    **b.names_sql("used", "genre"),
    "genre_found": GENRE_SQL,
}
add("genre_issues",
    lambda s, d: ql.genre_issues(b.order_albums(s, d), b.TAX),
    f"SELECT {C} FROM genre_found", USED)

P_USED = {**USED, "used": "SELECT album_key, artist, album, unnest(genres) AS genre FROM part_albums"}
add("genre_issues_lists",
    lambda s, d: ql.genre_issues(b.part_albums(s, d), b.TAX),
    f"SELECT {C} FROM genre_found", P_USED)

ARTISTS = {
    **b.lists_sql("order_albums"),
    "artist_facts": """
        SELECT a.artist, count(DISTINCT a.album_key) AS n, count(DISTINCT a.album_key) FILTER (len(genres) > 0) AS w,
               count(DISTINCT l.genre) AS u
        FROM order_albums a LEFT JOIN norm_list l ON l.album_key = a.album_key GROUP BY 1""",
    "artist_found": """
        SELECT 'artist_inconsistency' AS issue_type, 'warning' AS severity, '' AS album_key, artist, '' AS album,
               'Artist has ' || u || ' different genres across ' || w || ' albums' AS description,
               'Review and standardize artist''s primary genres' AS suggested_fix, 70::double AS confidence
        FROM artist_facts WHERE n >= 2 AND w >= 2 AND u > 10 AND w > 5
        UNION ALL
        SELECT 'missing_genres', 'info', '', artist, '', (n - w) || '/' || n || ' albums missing genres ('
               || CAST(round((n - w) / n * 100) AS INTEGER) || '%)',
               'Add genres to albums based on artist''s common genres', 80::double
        FROM artist_facts WHERE n >= 2 AND w >= 2 AND (n - w) / n * 100 > 30""",
}
add("artist_consistency",
    lambda s, d: ql.artist_consistency(b.order_albums(s, d), b.TAX).withColumn("percentage_missing",
                                                                              r6("percentage_missing")),
    """SELECT artist, n AS n_albums, w AS with_genres, u AS unique_genres, n - w AS without_genres,
              round((n - w) / n * 100, 6) AS percentage_missing FROM artist_facts""", ARTISTS)

add("artist_issues",
    lambda s, d: ql.artist_issues(b.order_albums(s, d), b.TAX),
    f"SELECT {C} FROM artist_found", ARTISTS)

ROUGH = {
    "rough_found": " UNION ALL ".join([
        issue("missing_artist", "critical", lit("Missing artist name"),
              lit("Add artist name from file metadata or directory"), "trim(coalesce(artist, '')) = ''",
              source="(SELECT album_key, artist, coalesce(album, '') AS album FROM rough_albums)").replace(
            "artist, album,\n", "'' AS artist, album,\n"),
        issue("missing_album", "critical", lit("Missing album title"),
              lit("Add album title from file metadata or directory"), "trim(coalesce(album, '')) = ''",
              source="(SELECT album_key, coalesce(artist, '') AS artist, album FROM rough_albums)").replace(
            "artist, album,\n", "artist, '' AS album,\n"),
        issue("suspicious_metadata", "warning", lit("Artist and album names are identical"),
              lit("Verify metadata is correct"), "same",
              source="(SELECT album_key, coalesce(artist, '') AS artist, coalesce(album, '') AS album, "
                     "artist IS NOT DISTINCT FROM album AS same FROM rough_albums)")]),
}
add("completeness_issues",
    lambda s, d: ql.completeness_issues(b.rough_albums(s, d)),
    f"SELECT {C} FROM rough_found", ROUGH)

TRACKS = {
    "track_facts": """
        SELECT a.album_key, a.artist, a.album, count(*) AS n, count(*) FILTER (trim(title) = '') AS unnamed,
               count(DISTINCT t.artist) AS who
        FROM order_tracks t JOIN rough_albums a ON a.album_key = t.album_key GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "track_found": " UNION ALL ".join([
        issue("missing_track_names", "warning", "unnamed || '/' || n || ' tracks missing names'",
              lit("Add track names from file metadata"), "unnamed > 0", source="track_facts"),
        issue("multiple_artists", "info", "'Album has ' || who || ' different track artists'",
              lit("Consider if this is a compilation album"), "who > 3", source="track_facts")]),
}
add("track_issues",
    lambda s, d: ql.track_issues(b.rough_albums(s, d), b.order_tracks(s, d)),
    f"SELECT {C} FROM track_found", TRACKS)

add("duplicate_issues",
    lambda s, d: ql.duplicate_issues(b.part_albums(s, d)).groupBy("album_key", "artist", "album", "severity").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max("confidence")).alias("top")),
    """SELECT key1 AS album_key, artist, album, 'warning' AS severity, count(*) AS n,
              round(max(similarity * 100), 6) AS top
       FROM sims JOIN part_albums ON album_key = key1 WHERE similarity >= 0.85::double GROUP BY 1, 2, 3""",
    {"sims": __import__("suite.q_matching", fromlist=["PAIRS"]).PAIRS["sims"]})

# The lists of the worn albums, under names of their own beside those of single values.
_LISTS = b.lists_sql("worn_albums")
WORN_LISTS = {f"w_{k}": re.sub(rf"\b({'|'.join(_LISTS)})\b(?!\.)", r"w_\1", v) for k, v in _LISTS.items()}
WORN = {
    **USED, "used": "SELECT album_key, artist, album, unnest(genres) AS genre FROM worn_albums",
    **WORN_LISTS,
    "artist_facts": """
        SELECT a.artist, n, w, coalesce(u, 0) AS u
        FROM (SELECT artist, count(*) AS n, count(*) FILTER (len(genres) > 0) AS w FROM worn_albums GROUP BY 1) a
        LEFT JOIN (SELECT artist, count(DISTINCT genre) AS u FROM worn_albums JOIN w_norm_list USING (album_key)
                   GROUP BY 1) l ON l.artist IS NOT DISTINCT FROM a.artist""",
    "track_facts": """
        SELECT album_key, artist, album, t.n, who, unnamed
        FROM (SELECT p_brand || '|' || p_name AS album_key, count(*) AS n, count(DISTINCT s_name) AS who,
                     count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS unnamed
              FROM lines GROUP BY 1 HAVING count(*) >= 2) t JOIN worn_albums USING (album_key)""",
    "artist_found": ARTISTS["artist_found"], "track_found": TRACKS["track_found"],
    "gaps_found": ROUGH["rough_found"].replace("rough_albums", "worn_albums"),
    "names": """
        SELECT album_key, lower(coalesce(artist, '')) AS a, lower(coalesce(album, '')) AS t, track_count AS n
        FROM worn_albums""",
    "sigs": "SELECT a, t, n, min(album_key) AS album_key, count(*) AS copies FROM names GROUP BY 1, 2, 3",
    "alike": f"""
        SELECT x.album_key, y.album_key AS other,
               ({lev('x.a', 'y.a')}) * 0.4::double + ({lev('x.t', 'y.t')}) * 0.5::double
               + (1::double - abs(x.n - y.n)::double / greatest(x.n, y.n)::double) * 0.1::double AS similarity
        FROM sigs x JOIN sigs y ON x.album_key < y.album_key
        UNION ALL SELECT m.album_key, sigs.album_key, 1::double FROM names m JOIN sigs USING (a, t, n)
        WHERE m.album_key <> sigs.album_key""",
    "alike_found": """
        SELECT 'potential_duplicate' AS issue_type, 'warning' AS severity, a.album_key, a.artist, a.album,
               'Potential duplicate: "' || coalesce(o.artist, 'null') || ' - ' || o.album || '" (similarity: '
               || CAST(round(similarity * 100) AS INTEGER) || '%)' AS description,
               'Review and remove duplicate or mark as different edition' AS suggested_fix, similarity * 100 AS confidence
        FROM alike JOIN worn_albums a ON a.album_key = alike.album_key JOIN worn_albums o ON o.album_key = other
        WHERE similarity >= 0.85::double""",
    "every": " UNION ALL ".join(f"SELECT {C} FROM {part}_found"
                                for part in ("genre", "artist", "gaps", "track", "alike")),
}


def issues(s, d):
    """All rules, near-duplicates included, over the worn albums and their tracks."""
    return ql.all_issues(b.worn_albums(s, d), b.part_tracks(s, d), b.TAX)


add("issue_summary",
    lambda s, d: ql.issue_summary(issues(s, d)),
    """SELECT 'total' AS level, 'all' AS name, count(*) AS n FROM every
       UNION ALL SELECT 'severity', severity, count(*) FROM every GROUP BY severity
       UNION ALL SELECT 'type', issue_type, count(*) FROM every GROUP BY issue_type""", WORN)

add("full_quality_run",
    lambda s, d: ql.issue_summary(issues(s, d)),
    """SELECT 'total' AS level, 'all' AS name, count(*) AS n FROM every
       UNION ALL SELECT 'severity', severity, count(*) FROM every GROUP BY severity
       UNION ALL SELECT 'type', issue_type, count(*) FROM every GROUP BY issue_type""", WORN)

add("quality_scores",
    lambda s, d: ql.scores(b.worn_albums(s, d), issues(s, d)).select(
        "total_albums", "albums_with_genres", "total_issues", "critical_issues", "warning_issues", "info_issues",
        r6("quality_exact").alias("quality"), r6("consistency_exact").alias("consistency")),
    """SELECT a.n AS total_albums, a.w AS albums_with_genres, t AS total_issues, c AS critical_issues,
              wa AS warning_issues, i AS info_issues,
              round(greatest(0::double, 100 - (c * 5 + wa * 2 + i * 0.5::double) / a.n), 6) AS quality,
              round(greatest(0::double, a.w / a.n * 100 - k / a.n * 20), 6) AS consistency
       FROM (SELECT count(*) AS n, count(*) FILTER (len(genres) > 0) AS w FROM worn_albums) a,
            (SELECT count(*) AS t, count(*) FILTER (severity = 'critical') AS c,
                    count(*) FILTER (severity = 'warning') AS wa, count(*) FILTER (severity = 'info') AS i,
                    count(*) FILTER (issue_type IN ('artist_inconsistency', 'unknown_genre', 'invalid_format')) AS k
             FROM every) e""", WORN)

add("top_issues",
    lambda s, d: ql.top_issues(issues(s, d)),
    f"""SELECT {C} FROM every ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC,
        confidence DESC, issue_type, album_key, artist, description LIMIT 20""", WORN)

# Every pair of order albums is compared here: numbered series whose names are all alike.
add("order_album_duplicates",
    lambda s, d: ql.duplicate_issues(b.order_albums(s, d)).groupBy("album_key", "artist", "album").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max("confidence")).alias("top")),
    f"""SELECT x.album_key, any_value(x.artist) AS artist, any_value(x.album) AS album, count(*) AS n,
               round(max(({lev('x.a', 'y.a')}) * 0.4::double + ({lev('x.t', 'y.t')}) * 0.5::double
                         + ({{c}}) * 0.1::double) * 100, 6) AS top
        FROM low x JOIN low y ON x.album_key < y.album_key AND abs(length(x.t) - length(y.t)) <= 9
        WHERE ({lev('x.a', 'y.a')}) * 0.4::double + ({lev('x.t', 'y.t')}) * 0.5::double + ({{c}}) * 0.1::double
              >= 0.85::double GROUP BY 1""".format(
        c="CASE WHEN x.n > 0 AND y.n > 0 THEN 1::double - abs(x.n - y.n)::double / greatest(x.n, y.n)::double "
          "ELSE 0.5::double END"),
    {"low": "SELECT album_key, artist, album, lower(artist) AS a, lower(album) AS t, track_count AS n FROM order_albums"})


def saved_report(s, d):
    """The report of the worn albums, saved twice under one id, beside one under another."""
    path = scratch_path(s, "reports")
    for report_id in ("r1", "r1", "r2"):
        run_report(b.worn_albums(s, d), b.part_tracks(s, d), b.TAX, path, report_id, b.now())
    reports = store.read_log(s, path, "quality_reports", "report_id").select("report_id", "total_issues")
    stored = store.read_log(s, path, "quality_issues", "report_id").groupBy("report_id", "issue_type").agg(
        F.count(F.lit(1)).alias("n"))
    return stored.join(reports, "report_id").select("report_id", "issue_type", "n", "total_issues")


add("saved_quality_reports", saved_report,
    """SELECT report_id, issue_type, n, total_issues
       FROM (SELECT issue_type, count(*) AS n FROM every GROUP BY 1), (SELECT count(*) AS total_issues FROM every),
            (SELECT unnest(['r1', 'r2']) AS report_id)""", WORN)
