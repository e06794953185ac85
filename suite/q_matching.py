"""Similarity, candidate matching, votes, caches, near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import dedup
from shelfmark.operators import matching as mt
from shelfmark.refdata import SOURCE_ORDER
from shelfmark.sources import cache as ch
from suite import bindings as b

QUERIES = {}


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


def r6(c):
    return F.round(c, 6)


def lev(a, c):
    return (f"CASE WHEN greatest(length({a}), length({c})) = 0 THEN 1::double ELSE 1::double - "
            f"levenshtein(lower({a}), lower({c}))::double / greatest(length({a}), length({c}))::double END")


RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCE_ORDER, 1)) + " ELSE 99 END"

SCORED = {
    "scored": f"""
        SELECT c.*, a.artist, a.album,
               (({lev('a.artist', 'cand_artist')}) + ({lev('a.album', 'cand_title')})) / 2::double AS score
        FROM candidates c JOIN part_albums a ON a.album_key = c.entity_key""",
    "best": f"""
        SELECT * FROM scored WHERE score >= 0.7::double
        QUALIFY row_number() OVER (PARTITION BY entity_key
                ORDER BY score DESC, {RANK}, position, cand_artist, cand_title) = 1""",
}

add("levenshtein_similarity",
    lambda s, d: b.candidates(s, d).select("entity_key", "cand_artist", "cand_title").distinct().select(
        "entity_key", "cand_artist", "cand_title",
        r6(tx.levenshtein_similarity("entity_key", F.concat_ws("|", "cand_artist", "cand_title"))).alias("sim")),
    f"""SELECT DISTINCT entity_key, cand_artist, cand_title,
               round({lev('entity_key', "(cand_artist || '|' || cand_title)")}, 6) AS sim FROM candidates""")

add("pair_scores",
    lambda s, d: mt.scored_candidates(b.part_albums(s, d), b.candidates(s, d)).groupBy("entity_key", "source").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max("score")).alias("top"), r6(F.min("score")).alias("low")),
    """SELECT entity_key, source, count(*) AS n, round(max(score), 6) AS top, round(min(score), 6) AS low
       FROM scored WHERE score >= 0.7::double GROUP BY 1, 2""", SCORED)

add("best_match",
    lambda s, d: mt.best_match(b.part_albums(s, d), b.candidates(s, d)).select(
        "entity_key", "artist", "album", "source", "cand_artist", "cand_title", "position",
        r6("match_confidence").alias("match_confidence"), "status"),
    """SELECT a.album_key AS entity_key, a.artist, a.album, source, cand_artist, cand_title, position,
              round(coalesce(score * 100, 0), 6) AS match_confidence,
              CASE WHEN score IS NULL THEN 'skipped' ELSE 'needs_review' END AS status
       FROM part_albums a LEFT JOIN best ON entity_key = a.album_key""", SCORED)

add("best_per_source",
    lambda s, d: mt.best_per_source(b.part_albums(s, d), b.candidates(s, d)).select(
        "entity_key", "source", "cand_artist", "cand_title", "position", r6("score").alias("score")),
    """SELECT entity_key, source, cand_artist, cand_title, position, round(score, 6) AS score
       FROM scored WHERE score >= 0.7::double
       QUALIFY row_number() OVER (PARTITION BY entity_key, source
               ORDER BY score DESC, position, cand_artist, cand_title) = 1""", SCORED)

add("match_sequence_metric",
    lambda s, d: mt.best_match(b.part_albums(s, d), b.candidates(s, d), metric="sequence").select(
        "entity_key", "source", "cand_artist", "cand_title", r6("match_confidence").alias("match_confidence")))

add("name_percentages",
    lambda s, d: mt.compare_names(b.candidates(s, d).join(
        b.part_albums(s, d).select(F.col("album_key").alias("entity_key"), "artist", "album"), "entity_key")).groupBy(
        "entity_key").agg(F.max("mean_pct").alias("best_pct"), F.count(F.lit(1)).alias("n")))

add("match_strategies",
    lambda s, d: mt.strategy_keys(b.order_albums(s, d)),
    """SELECT album_key, strategy, CASE WHEN strategy IN ('normalized', 'fuzzy_artist') THEN na ELSE artist END
              AS key_artist, CASE WHEN strategy IN ('normalized', 'fuzzy_album') THEN nb ELSE album END AS key_album,
              CASE WHEN strategy = 'loose' THEN key_artist || ' ' || key_album ELSE
                   'artist:"' || key_artist || '" AND release:"' || key_album || '"' END AS query
       FROM (SELECT album_key, artist, album, lower(regexp_replace(artist, '[^\\w\\s]', '', 'g')) AS na,
                    lower(regexp_replace(album, '[^\\w\\s]', '', 'g')) AS nb,
                    unnest(['exact', 'normalized', 'fuzzy_artist', 'fuzzy_album', 'loose']) AS strategy
             FROM order_albums)""")


def wanted(s, d):
    """Distinct names the sources returned, some of them in capitals."""
    c = b.candidates(s, d)
    title = F.when(F.col("source") == "deezer", F.upper("cand_title")).otherwise(F.col("cand_title"))
    return c.select(F.concat_ws("|", "cand_artist", title).alias("album_key"), F.col("cand_artist").alias("artist"),
                    title.alias("album")).distinct()


TIERS = {
    "asked": """
        SELECT DISTINCT cand_artist || '|' || t AS entity_key, cand_artist AS artist, t AS album
        FROM (SELECT cand_artist, CASE source WHEN 'deezer' THEN upper(cand_title) ELSE cand_title END AS t
              FROM candidates)""",
    "tier_hits": r"""
        SELECT entity_key, a.album_key AS found_key,
               CASE WHEN q.artist = a.artist AND q.album = a.album THEN 1
                    WHEN lower(q.artist) = lower(a.artist) AND lower(q.album) = lower(a.album) THEN 2
                    WHEN q.artist = a.artist THEN 3 ELSE 4 END AS tier
        FROM asked q JOIN part_albums a
          ON regexp_replace(lower(q.album), '\s+\(deluxe\)$', '') = lower(a.album)""",
    "tier_min": "SELECT entity_key, min(tier) AS best_tier FROM tier_hits GROUP BY 1",
}
add("tiered_search",
    lambda s, d: mt.tiered_search(wanted(s, d), b.part_albums(s, d)).select("entity_key", "tier", "n_hits"),
    """SELECT h.entity_key, ['exact', 'quoted', 'broad', 'album_focused'][best_tier] AS tier, count(*) AS n_hits
       FROM tier_hits h JOIN tier_min m ON h.entity_key = m.entity_key AND tier <= best_tier GROUP BY ALL""", TIERS)


def listed_hits(s, d):
    found = mt.tiered_search(wanted(s, d), b.part_albums(s, d))
    return found.join(mt.search_hits(found, b.part_albums(s, d)), ["tier", "lookup_key"])


add("search_hits",
    lambda s, d: listed_hits(s, d).select("entity_key", "tier", "n_hits", "found_key"),
    """SELECT h.entity_key, ['exact', 'quoted', 'broad', 'album_focused'][best_tier] AS tier,
              count(*) OVER (PARTITION BY h.entity_key) AS n_hits, found_key
       FROM tier_hits h JOIN tier_min m ON h.entity_key = m.entity_key AND tier <= best_tier""", TIERS)

CORRECTED = {
    **SCORED,
    "fixes": f"""
        SELECT a.album_key, a.artist, a.album, cand_artist, cand_title,
               ({lev('a.artist', 'cand_artist')}) * 100 AS ac, ({lev('a.album', 'cand_title')}) * 100 AS bc
        FROM part_albums a LEFT JOIN best ON entity_key = a.album_key""",
    "said": """
        SELECT *, CASE WHEN ac < 98 THEN 'Artist: "' || artist || '" → "' || cand_artist || '" ('
                       || printf('%.1f', round(ac, 1)) || '%)' END AS pa,
                  CASE WHEN bc < 98 THEN 'Album: "' || album || '" → "' || cand_title || '" ('
                       || printf('%.1f', round(bc, 1)) || '%)' END AS pb FROM fixes""",
}


def corrections(s, d):
    best = mt.best_match(b.part_albums(s, d), b.candidates(s, d))
    return mt.metadata_corrections(best.withColumnRenamed("entity_key", "album_key").drop("status"))


add("metadata_corrections",
    lambda s, d: corrections(s, d).select(
        "album_key", "corrected_artist", "corrected_album", r6("overall_confidence").alias("overall_confidence"),
        "reason", "status"),
    """SELECT album_key, CASE WHEN ac < 98 THEN cand_artist END AS corrected_artist,
              CASE WHEN bc < 98 THEN cand_title END AS corrected_album,
              round(coalesce((ac + bc) / 2, 0), 6) AS overall_confidence,
              CASE WHEN cand_artist IS NULL THEN 'No metadata found' WHEN concat_ws('; ', pa, pb) = ''
                   THEN 'No corrections needed' ELSE concat_ws('; ', pa, pb) END AS reason,
              CASE WHEN coalesce((ac + bc) / 2, 0) >= 40 THEN 'needs_review' ELSE 'skipped' END AS status
       FROM said""", CORRECTED)

add("parse_corrections",
    lambda s, d: corrections(s, d).select("album_key", "reason").withColumns(mt.parse_corrections("reason")).drop(
        "reason"),
    """SELECT album_key, CASE WHEN ac < 98 THEN cand_artist END AS corrected_artist,
              CASE WHEN bc < 98 THEN cand_title END AS corrected_album FROM fixes""", CORRECTED)

add("confidence_units",
    lambda s, d: b.table(s, d, "events").select("event_id", r6(mt.as_percent("value")).alias("pct")),
    "SELECT event_id, round(CASE WHEN value <= 1 THEN value * 100 ELSE value END, 6) AS pct FROM events")

VOTES = {
    "cast_votes": f"""
        SELECT entity_key, source, {b.title_sql('g')} AS genre, weight * (confidence / 100) AS v
        FROM (SELECT *, unnest(genres) AS g FROM votes)""",
    "vote_sums": """SELECT entity_key, genre, round(sum(v), 9) AS score,
                           array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources
                    FROM cast_votes GROUP BY 1, 2""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY score DESC, genre) AS rank
                 FROM vote_sums WHERE score >= 0.3::double QUALIFY rank <= 10""",
    "finals": """SELECT entity_key, list(genre ORDER BY rank) AS final_genres, count(*) AS n_genres,
                        string_agg(genre || ' (' || sources || ')', '; ' ORDER BY rank) FILTER (rank <= 3) AS labels
                 FROM ranked GROUP BY 1""",
    "used": "SELECT entity_key, count(*) AS n_sources, list_sort(list(source)) AS sources_used FROM votes GROUP BY 1",
    "aggregated": """
        SELECT e.entity_key, coalesce(final_genres, []) AS final_genres, coalesce(sources_used, []) AS sources_used,
               coalesce(n_sources, 0) AS n_sources,
               CASE WHEN n_sources IS NULL THEN 0::double ELSE least(100, CASE WHEN n_genres > 0 THEN 60 ELSE 0 END
                    + 10 * n_sources + least(20, 5 * coalesce(n_genres, 0)))::double END AS confidence,
               CASE WHEN n_sources IS NULL THEN 'No sources returned genres' ELSE
                    'Aggregated from ' || n_sources || ' sources: ' || coalesce(labels, '') END AS reasoning
        FROM vote_entities e LEFT JOIN used u ON u.entity_key = e.entity_key
        LEFT JOIN finals f ON f.entity_key = e.entity_key""",
}
add("vote_scores",
    lambda s, d: mt.vote_scores(b.votes(s, d)).select("entity_key", "genre", r6("score").alias("score"),
                                                      F.array_join("sources", ", ").alias("sources")),
    "SELECT entity_key, genre, round(score, 6) AS score, sources FROM vote_sums", VOTES)

add("aggregate_votes",
    lambda s, d: mt.aggregate_votes(b.vote_entities(s, d), b.votes(s, d)).select(
        "entity_key", F.array_join("final_genres", "~").alias("final_genres"),
        F.array_join("sources_used", "~").alias("sources_used"), "n_sources", "confidence", "reasoning"),
    """SELECT entity_key, array_to_string(final_genres, '~') AS final_genres,
              array_to_string(sources_used, '~') AS sources_used, n_sources, confidence, reasoning
       FROM aggregated""", VOTES)


def styled_albums(s, d):
    """All customers as albums; those with a key the events know already have one style."""
    return b.user_albums(s, d).withColumn("genres", F.when(F.col("year") > 1990, F.array(F.lit("Style 3"))).otherwise(
        F.array().cast("array<string>")))


STYLED = {**VOTES, "styled": """SELECT *, CASE WHEN year > 1990 THEN ['Style 3'] ELSE [] END AS had
                                FROM user_albums"""}


def aggregated(s, d):
    return mt.aggregate_votes(b.vote_entities(s, d), b.votes(s, d))


add("match_rate",
    lambda s, d: mt.match_rate(styled_albums(s, d), aggregated(s, d), 95.0).withColumn(
        "match_rate", r6("match_rate")).withColumn("improvement_rate", r6("improvement_rate")),
    """SELECT processed, matched, processed - matched AS no_match, CAST(0 AS BIGINT) AS errors, improved, with_genres,
              without_genres, round(matched / processed * 100, 6) AS match_rate,
              round(improved / processed * 100, 6) AS improvement_rate,
              CASE WHEN matched / processed >= 0.7 THEN 'excellent' WHEN matched / processed >= 0.5 THEN 'good'
                   ELSE 'low' END AS match_band,
              CASE WHEN improved / processed >= 0.5 THEN 'high' WHEN improved / processed >= 0.25 THEN 'moderate'
                   ELSE 'limited' END AS improvement_band
       FROM (SELECT count(*) AS processed, count(*) FILTER (confidence >= 95 AND len(final_genres) > 0) AS matched,
                    count(*) FILTER (confidence >= 95 AND len(list_filter(final_genres,
                        lambda x: NOT list_contains(had, x))) > 0) AS improved,
                    count(*) FILTER (len(had) > 0) AS with_genres, count(*) FILTER (len(had) = 0) AS without_genres
             FROM styled JOIN aggregated ON entity_key = album_key)""", STYLED)

add("source_usage",
    lambda s, d: mt.source_usage(aggregated(s, d)),
    "SELECT source, count(*) AS n_albums FROM votes GROUP BY 1")

add("top_matches",
    lambda s, d: mt.top_matches(styled_albums(s, d), aggregated(s, d)).select(
        "entity_key", "artist", "album", "confidence", "would_improve"),
    """SELECT entity_key, artist, album, confidence,
              len(list_filter(final_genres, lambda x: NOT list_contains(had, x))) > 0 AS would_improve
       FROM styled JOIN aggregated ON entity_key = album_key WHERE confidence > 20
       ORDER BY confidence DESC, entity_key LIMIT 10""", STYLED)

LIVE = {
    "live": f"SELECT * FROM cache_rows WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{b.NOW}'",
    "best_live": """
        SELECT lower(artist) AS ka, lower(album) AS kb, source, confidence, weight FROM live WHERE confidence * weight > 0
        QUALIFY row_number() OVER (PARTITION BY lower(artist), lower(album)
                ORDER BY confidence * weight DESC, weight DESC, source) = 1""",
}
add("best_cached",
    lambda s, d: mt.best_cached(b.user_albums(s, d).select("album_key", "artist", "album"), b.cache_rows(s, d), b.now())
    .select("album_key", "source", r6("cached_confidence").alias("cached_confidence"), "weight"),
    """SELECT album_key, source, round(CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END, 6)
              AS cached_confidence, weight
       FROM user_albums LEFT JOIN best_live ON ka = lower(artist) AND kb = lower(album)""", LIVE)

add("review_worklist",
    lambda s, d: mt.review_worklist(b.job_results(s, d), b.user_albums(s, d), b.cache_rows(s, d), b.now(), 30.0).select(
        "album_key", "job_id", "status", r6("confidence").alias("confidence"), "source",
        r6("cached_confidence").alias("cached_confidence")),
    """SELECT w.album_key, job_id, status, round(w.confidence, 6) AS confidence, source,
              round(CASE WHEN l.confidence <= 1 THEN l.confidence * 100 ELSE l.confidence END, 6) AS cached_confidence
       FROM (SELECT * FROM job_results WHERE status IN ('failed', 'needs_review', 'skipped')
             QUALIFY row_number() OVER (PARTITION BY album_key ORDER BY confidence DESC, job_id, created_at) = 1) w
       JOIN user_albums a ON a.album_key = w.album_key
       LEFT JOIN best_live l ON ka = lower(a.artist) AND kb = lower(a.album)
       WHERE coalesce(CASE WHEN l.confidence <= 1 THEN l.confidence * 100 ELSE l.confidence END, 0) >= 30""", LIVE)

add("cache_statistics",
    lambda s, d: mt.cache_statistics(b.cache_rows(s, d), b.now()),
    f"""SELECT source, count(*) AS total, count(*) FILTER (expires_at IS NULL OR expires_at > TIMESTAMP '{b.NOW}')
               AS unexpired FROM cache_rows GROUP BY 1""")


def cached(s, d):
    rows = b.cache_rows(s, d).withColumn("cache_key", ch.cache_key("artist", "album", "source"))
    rows = rows.select("cache_key", *[c for c in rows.columns if c != "cache_key"])
    early = F.col("created_at") < F.lit("2024-01-15").cast("timestamp")
    return ch.put(rows.where(early), rows.where(~early))


add("cache_upsert",
    lambda s, d: cached(s, d).select("artist", "source", r6("confidence").alias("confidence"),
                                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")),
    """SELECT artist, source, round(confidence, 6) AS confidence, strftime(created_at, '%Y-%m-%d %H:%M:%S')
              AS created_at
       FROM cache_rows QUALIFY row_number() OVER (PARTITION BY artist, source ORDER BY created_at DESC) = 1""")

add("cache_lookup",
    lambda s, d: ch.get(cached(s, d), b.user_albums(s, d).select("artist", "album", F.lit("spotify").alias("source")),
                        b.now()).select("artist", "source"),
    f"""SELECT artist, source FROM cache_rows WHERE source = 'spotify' AND lower(artist) IN (
            SELECT lower(artist) FROM user_albums) GROUP BY 1, 2
        HAVING max(expires_at) > TIMESTAMP '{b.NOW}'""")

LIBRARY = {
    **SCORED,
    "part_votes": f"""
        SELECT p_brand || '|' || p_name AS entity_key, {b._case('l_returnflag', b.SOURCE_OF_FLAG)} AS source,
               list(DISTINCT {b._case('p_type', b.GENRE_OF_TYPE)}) AS genres,
               100 - min(l_quantity) AS confidence, CAST(0.8 AS DOUBLE) AS weight
        FROM lines GROUP BY 1, 2""",
    "p_cast": f"""
        SELECT v.entity_key, source, CASE t WHEN 'Hip-Hop' THEN 'Hip Hop' ELSE t END AS genre,
               weight * (confidence / 100) AS vote
        FROM (SELECT *, {b.title_sql('g')} AS t FROM (SELECT *, unnest(genres) AS g FROM part_votes)) v
        WHERE v.entity_key IN (SELECT entity_key FROM best)""",
    "p_sums": "SELECT entity_key, genre, round(sum(vote), 9) AS s FROM p_cast GROUP BY 1, 2",
    "p_top": """SELECT entity_key, genre, row_number() OVER (PARTITION BY entity_key ORDER BY s DESC, genre) AS r
                FROM p_sums WHERE s >= 0.3::double QUALIFY r <= 10""",
    "p_final": "SELECT entity_key, list(genre ORDER BY r) AS fg FROM p_top GROUP BY 1",
    "p_used": """SELECT entity_key, count(*) AS ns FROM part_votes WHERE entity_key IN (SELECT entity_key FROM best)
                 GROUP BY 1""",
}


def part_votes(s, d):
    return (b.lines(s, d).groupBy(F.concat_ws("|", "p_brand", "p_name").alias("entity_key"),
                                  b.choose("l_returnflag", b.SOURCE_OF_FLAG).alias("source"))
            .agg(F.collect_set(b.choose("p_type", b.GENRE_OF_TYPE)).alias("genres"),
                 (F.lit(100.0) - F.min("l_quantity")).alias("confidence"))
            .withColumn("weight", F.lit(0.8)))


add("match_library",
    lambda s, d: mt.match_library(b.part_albums(s, d), b.candidates(s, d), part_votes(s, d)).select(
        "entity_key", F.array_join("final_genres", "~").alias("final_genres"), "confidence",
        r6("overall_confidence").alias("overall_confidence"), "status"),
    """SELECT a.album_key AS entity_key, coalesce(array_to_string(fg, '~'), '') AS final_genres,
              CASE WHEN ns IS NULL THEN 0::double ELSE least(100, CASE WHEN len(fg) > 0 THEN 60 ELSE 0 END + 10 * ns
                   + least(20, 5 * coalesce(len(fg), 0)))::double END AS confidence,
              round(coalesce(score * 100, 0), 6) AS overall_confidence,
              CASE WHEN score IS NULL THEN 'skipped' ELSE 'needs_review' END AS status
       FROM part_albums a LEFT JOIN best m ON m.entity_key = a.album_key
       LEFT JOIN p_final f ON f.entity_key = a.album_key LEFT JOIN p_used u ON u.entity_key = a.album_key""", LIBRARY)

# --- near-duplicates --------------------------------------------------------

PAIRS = {
    "sims": f"""
        SELECT x.album_key AS key1, y.album_key AS key2,
               ({lev('x.artist', 'y.artist')}) * 0.4::double + ({lev('x.album', 'y.album')}) * 0.5::double
               + (1::double - abs(x.track_count - y.track_count)::double
                  / greatest(x.track_count, y.track_count)::double) * 0.1::double AS similarity
        FROM part_albums x JOIN part_albums y ON x.album_key < y.album_key""",
}
add("duplicate_pairs",
    lambda s, d: dedup.duplicate_pairs(b.part_albums(s, d)).select("key1", "key2", r6("similarity").alias("similarity")),
    "SELECT key1, key2, round(similarity, 6) AS similarity FROM sims WHERE similarity >= 0.85::double", PAIRS)

add("duplicate_pairs_strict",
    lambda s, d: dedup.duplicate_pairs(b.part_albums(s, d), 0.95).select("key1", "key2"),
    "SELECT key1, key2 FROM sims WHERE similarity >= 0.95::double", PAIRS)


def page_albums(s, d):
    """Pages as albums: host as artist, whole normalised title as album."""
    p = b.table(s, d, "pages")
    return p.select(F.col("page_id").cast("string").alias("album_key"),
                    F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("artist"),
                    F.regexp_replace(tx.normalize_name(F.regexp_extract("html", "<title>([^<]*)</title>", 1)),
                                     r"[^\x00-\x7F]", "?").alias("album"),
                    F.length(F.regexp_extract("url", "/([0-9]+)", 1)).cast("bigint").alias("track_count"))


add("duplicate_pages",
    lambda s, d: dedup.duplicate_pairs(page_albums(s, d)).select("key1", "key2",
                                                                      r6("similarity").alias("similarity")),
    f"""SELECT least(k1, k2) AS key1, greatest(k1, k2) AS key2, round(similarity, 6) AS similarity
        FROM (SELECT x.album_key AS k1, y.album_key AS k2,
                     ({lev('x.artist', 'y.artist')}) * 0.4::double + ({lev('x.album', 'y.album')}) * 0.5::double
                     + CASE WHEN x.n > 0 AND y.n > 0 THEN 1::double - abs(x.n - y.n)::double
                            / greatest(x.n, y.n)::double ELSE 0.5::double END * 0.1::double AS similarity
              FROM page_albums x JOIN page_albums y ON x.album_key < y.album_key) WHERE similarity >= 0.85::double""",
    {"page_albums": "SELECT min(album_key) AS album_key, artist, album, n FROM page_rows GROUP BY 2, 3, 4",
     "page_rows": r"""
        SELECT CAST(page_id AS VARCHAR) AS album_key, regexp_extract(url, '^https?://([^/]+)/', 1) AS artist,
               regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(
                   strip_accents(regexp_extract(html, '<title>([^<]*)</title>', 1)), '^(The|A|An)\s+', '', 'i'),
                   '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))), '[^\x00-\x7F]', '?', 'g') AS album,
               length(regexp_extract(url, '/([0-9]+)', 1)) AS n FROM pages"""})


def copied_albums(s, d):
    """Orders as albums named by customer segment and priority: large groups of copies."""
    o = b.table(s, d, "orders").join(b.table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return o.select(F.col("o_orderkey").cast("string").alias("album_key"), F.col("c_mktsegment").alias("artist"),
                    F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
                    .alias("album"), F.year("o_orderdate").cast("bigint").alias("track_count"))


COPIES = {
    "copied": """
        SELECT CAST(o_orderkey AS VARCHAR) AS album_key, c_mktsegment AS a, lower(o_orderpriority) AS t,
               year(o_orderdate) AS n FROM orders JOIN customer ON c_custkey = o_custkey""",
    "sig": "SELECT a, t, n, min(album_key) AS canonical_key, count(*) AS members FROM copied GROUP BY 1, 2, 3",
}
add("duplicate_members",
    lambda s, d: dedup.duplicate_members(copied_albums(s, d)).select("album_key", "canonical_key", "members"),
    """SELECT album_key, canonical_key, members FROM copied c JOIN sig s ON c.a = s.a AND c.t = s.t AND c.n = s.n
       WHERE album_key <> canonical_key""", COPIES)

add("duplicate_groups",
    lambda s, d: dedup.duplicate_pairs(copied_albums(s, d)).select(
        "key1", "key2", r6("similarity").alias("similarity"), "members1", "members2"),
    f"""SELECT x.canonical_key AS key1, y.canonical_key AS key2,
               round(({lev('x.a', 'y.a')}) * 0.4::double + ({lev('x.t', 'y.t')}) * 0.5::double
               + (1::double - abs(x.n - y.n)::double / greatest(x.n, y.n)::double) * 0.1::double, 6) AS similarity,
               x.members AS members1, y.members AS members2
        FROM sig x JOIN sig y ON x.canonical_key < y.canonical_key WHERE similarity >= 0.85::double""", COPIES)
