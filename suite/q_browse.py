"""Album lists: status, search, filters, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import albums as al
from shelfmark.operators import browse as br
from shelfmark.plans import browse_page as bp
from suite import bindings as b

QUERIES = {}


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


STATUS = {
    "newest": """SELECT * FROM job_results QUALIFY row_number() OVER (PARTITION BY album_key
                 ORDER BY created_at DESC, job_id DESC) = 1""",
    "with_status": """
        SELECT a.album_key, a.artist, a.album, a.year,
               CASE WHEN r.album_key IS NULL THEN 'never_scanned' ELSE coalesce(r.scan_status, 'scanned') END
                   AS scan_status, n.status AS batch_status,
               CASE WHEN n.status IN ('completed', 'approved') THEN 'matched' ELSE 'never_matched' END AS match_status,
               CASE WHEN r.error_message IS NOT NULL THEN 'error' WHEN n.status = 'needs_review' THEN 'review'
                    WHEN n.status IN ('completed', 'approved') THEN 'matched' ELSE 'never' END AS display_status,
               r.error_message, n.created_at AS last_matched, n.confidence
        FROM user_albums a LEFT JOIN user_registry r ON r.album_key = a.album_key
        LEFT JOIN newest n ON n.album_key = a.album_key""",
}
COLS = ["album_key", "artist", "scan_status", "batch_status", "match_status", "display_status"]

add("album_status",
    lambda s, d: br.with_status(b.user_albums(s, d), b.user_registry(s, d), b.job_results(s, d)).select(*COLS),
    f"SELECT {', '.join(COLS)} FROM with_status", STATUS)

add("older_display_status",
    lambda s, d: br.with_status(b.user_albums(s, d), b.user_registry(s, d), b.job_results(s, d)).select(
        br.display_status_by_confidence("scan_error", "last_matched", "match_confidence").alias("shown")).groupBy(
        "shown").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN error_message IS NOT NULL THEN 'Scan Error' WHEN last_matched IS NULL THEN 'Never Matched'
              WHEN confidence >= 80 THEN 'Matched ' || strftime(last_matched, '%Y-%m-%d') ELSE 'Needs Review' END
              AS shown, count(*) AS n FROM with_status GROUP BY 1""", STATUS)

add("album_search",
    lambda s, d: br.search(b.order_albums(s, d), "GREATEST hits 1").select("album_key"),
    "SELECT album_key FROM order_albums WHERE artist ILIKE '%greatest hits 1%' OR album ILIKE '%greatest hits 1%'")

for kind, where in {
    "review": "album_key IN (SELECT album_key FROM job_results WHERE status = 'needs_review')",
    "matched": "album_key IN (SELECT album_key FROM job_results WHERE status IN ('completed', 'approved'))",
    "never": "album_key NOT IN (SELECT album_key FROM job_results)",
    "errors": "album_key IN (SELECT album_key FROM user_registry WHERE error_message IS NOT NULL)",
}.items():
    add(f"filter_{kind}",
        lambda s, d, kind=kind: br.filter_albums(b.user_albums(s, d), kind, b.job_results(s, d),
                                                 b.user_registry(s, d)).select("album_key"),
        f"SELECT album_key FROM user_albums WHERE {where}")

add("filter_no_artwork",
    lambda s, d: br.filter_albums(b.order_albums(s, d), "no_artwork").select("album_key"),
    "SELECT album_key FROM order_albums WHERE NOT has_artwork")

BLANK = {
    "artist": "(coalesce(artist, '') = ''), artist NULLS FIRST, album NULLS FIRST, album_key",
    "album": "(coalesce(album, '') = ''), album NULLS FIRST, artist NULLS FIRST, album_key",
}
for sort, order in BLANK.items():
    add(f"page_by_{sort}",
        lambda s, d, sort=sort: br.album_page(b.rough_albums(s, d), 4, 200, sort).select("album_key", "artist", "album"),
        f"SELECT album_key, artist, album FROM rough_albums ORDER BY {order} LIMIT 200 OFFSET 600")

add("page_by_year",
    lambda s, d: br.album_page(b.part_albums(s, d), 3, 40, "year").select("album_key", "year"),
    "SELECT album_key, year FROM part_albums ORDER BY year DESC, artist, album_key LIMIT 40 OFFSET 80")

add("page_by_last_matched",
    lambda s, d: bp.browse(b.user_albums(s, d), b.user_registry(s, d), b.job_results(s, d), "", "all", "last_matched",
                           1, 60)[0].select("album_key", "display_status"),
    """SELECT album_key, display_status FROM with_status ORDER BY last_matched DESC NULLS LAST, album_key LIMIT 60""",
    STATUS)

add("browse_page",
    lambda s, d: bp.browse(b.user_albums(s, d), b.user_registry(s, d), b.job_results(s, d), "user 1", "matched",
                           "artist", 2, 20)[0].select(*COLS),
    f"""SELECT {', '.join(COLS)} FROM with_status
        WHERE artist ILIKE '%user 1%' AND album_key IN (SELECT album_key FROM job_results
              WHERE status IN ('completed', 'approved'))
        ORDER BY artist, album, album_key LIMIT 20 OFFSET 20""", STATUS)

add("browse_page_info",
    lambda s, d: bp.browse(b.user_albums(s, d), b.user_registry(s, d), b.job_results(s, d), "user 1", "matched",
                           "artist", 2, 20)[1],
    """SELECT count(*) AS total, CAST(2 AS INTEGER) AS page, CAST(20 AS INTEGER) AS per_page,
              CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages, true AS has_prev, 40 < count(*) AS has_next
       FROM user_albums WHERE artist ILIKE '%user 1%' AND album_key IN (SELECT album_key FROM job_results
              WHERE status IN ('completed', 'approved'))""")

add("page_after",
    lambda s, d: br.album_page_after(b.part_albums(s, d), ("Brand#15", "old bolt", "Brand#15|old bolt"), 50).select(
        "album_key"),
    """SELECT album_key FROM part_albums WHERE (artist, album, album_key) > ('Brand#15', 'old bolt', 'Brand#15|old bolt')
       ORDER BY artist, album, album_key LIMIT 50""")

add("at_threshold",
    lambda s, d: br.at_threshold(b.job_results(s, d), 62.5).groupBy("job_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT job_id, count(*) AS n FROM job_results WHERE confidence >= 62.5 GROUP BY 1")

add("sample_albums",
    lambda s, d: br.sample_albums(b.order_albums(s, d), 5).select("album_key", "artist"),
    "SELECT album_key, artist FROM order_albums ORDER BY album_key LIMIT 5")

add("album_page_tracks",
    lambda s, d: al.ordered_tracks(b.order_tracks(s, d), b.rough_albums(s, d).where("album_key = '120'")).select(
        "track_number", "title", "file_path"),
    "SELECT track_number, title, file_path FROM order_tracks WHERE album_key = '120'")
