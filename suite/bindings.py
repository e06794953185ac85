"""The given tables in catalogue roles, as DataFrames and as SQL.

Every binding reads whole tables. ``SQL`` holds the same definitions as common
table expressions; ``with_sql`` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.refdata import Taxonomy
from shelfmark.session import spread

TAX = Taxonomy.default()

SOURCE_OF_FLAG = {"A": "spotify", "N": "musicbrainz", "R": "deezer"}
SOURCE_OF_EVENT = {"click": "spotify", "view": "musicbrainz", "purchase": "deezer", "signup": "discogs",
                   "error": "lastfm"}
WEIGHT_OF_EVENT = {"click": 1.0, "view": 0.85, "purchase": 0.75, "signup": 0.8, "error": 0.7}
STATUS_OF_EVENT = {"click": "completed", "view": "needs_review", "error": "failed", "signup": "skipped",
                   "purchase": "approved"}
GENRE_OF_TYPE = {"ECONOMY": "Hip-Hop", "SMALL": "rock & roll", "MEDIUM": "The Folk Music", "PROMO": "R&B",
                 "STANDARD": "Atmospheric Black Metal", "LARGE": "Synthpop; IDM"}
TITLE_OF_PRIORITY = {"1-URGENT": "Live at Hall", "2-HIGH": "Greatest Hits", "3-MEDIUM": "Symphony No.",
                     "4-NOT SPECIFIED": "Unplugged Collection", "5-LOW": "Studio"}
DIR_OF_STATUS = {"F": "Doom Metal", "O": "Deep House", "P": "Misc"}
EXT_OF_FLAG = {"A": "FLAC", "N": "mp3", "R": "m3u"}
RAW_GENRE = {
    ("1-URGENT", "F"): "hip-hop", ("1-URGENT", "O"): "Rock & Roll", ("1-URGENT", "P"): "The Folk Music",
    ("2-HIGH", "F"): "R&B", ("2-HIGH", "O"): "Drum and Bass; IDM", ("2-HIGH", "P"): "Xyzzy   Core",
    ("3-MEDIUM", "F"): "123", ("3-MEDIUM", "O"): "", ("3-MEDIUM", "P"): "Rock//Pop",
    ("4-NOT SPECIFIED", "F"): "rock Rock", ("4-NOT SPECIFIED", "O"): "Atmospheric Black Metal",
    ("4-NOT SPECIFIED", "P"): "Rock/Blues", ("5-LOW", "F"): "EP", ("5-LOW", "O"): "Synth-Pop!",
    ("5-LOW", "P"): "a very long and winding name of a style that nobody has heard of",
}
NOW = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def choose(c: Column | str, values: dict[str, str | float]) -> Column:
    out = None
    key = F.col(c) if isinstance(c, str) else c
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def _case(c: str, values: dict) -> str:
    def lit(v):
        return f"{v}::double" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + " END"


def utc(c: str) -> Column:
    return F.col(c).cast("timestamp")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


# --- albums made of parts ---------------------------------------------------

def part_albums(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").groupBy(
        F.concat_ws("|", "p_brand", "p_name").alias("album_key"), F.col("p_brand").alias("artist"),
        F.col("p_name").alias("album"))
    return rows.agg(F.array_sort(F.collect_set(choose("p_type", GENRE_OF_TYPE))).alias("genres"),
                    F.count(F.lit(1)).alias("track_count"),
                    F.sum(F.col("p_size").cast("bigint")).cast("double").alias("total_duration"),
                    (F.min("p_size") + 1949).alias("year")).withColumn(
        "file_path", F.concat(F.lit("/lib/"), "artist", F.lit("/"), "album", F.lit(" ("),
                              F.col("year").cast("string"), F.lit(")/01.flac")))


# What the worn albums of one gap have among their categories.
ODD_CATEGORIES = {4: " ", 5: "1977", 6: "Progressive Symphonic Rock Of The Early And The Middle Seventies",
                  7: "Rock rock", 8: "Pop//Rock"}
BARE_ARTISTS = ["Brand#4", "Brand#11"]


def worn_albums(spark: SparkSession, sf: str) -> DataFrame:
    """The part albums with gaps: lost artists, blank and repeated titles, odd categories, artists without categories."""
    gap = F.col("total_duration").cast("bigint") % 20
    genres = F.when(F.col("artist").isin(BARE_ARTISTS) & (gap >= 10), F.array().cast("array<string>"))
    for at, odd in ODD_CATEGORIES.items():
        genres = genres.when(gap == at, F.array_append("genres", F.lit(odd)))
    return part_albums(spark, sf).withColumns({
        "artist": F.when(gap != 1, F.col("artist")),
        "album": F.when(gap == 2, " ").when(gap == 3, F.col("artist")).otherwise(F.col("album")),
        "genres": genres.otherwise(F.col("genres"))})


def part_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The tracks of the part albums: all lines of an album's parts."""
    unnamed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return lines(spark, sf).select(
        F.concat_ws("|", "p_brand", "p_name").alias("album_key"), F.col("l_linenumber").alias("track_number"),
        F.when(unnamed, " ").otherwise(F.col("p_name")).alias("title"), F.col("s_name").alias("artist"))


# --- albums made of orders --------------------------------------------------

def raw_genre() -> Column:
    out = None
    for (p, s), g in RAW_GENRE.items():
        hit = (F.col("o_orderpriority") == p) & (F.col("o_orderstatus") == s)
        out = F.when(hit, F.lit(g)) if out is None else out.when(hit, F.lit(g))
    return out


def order_albums(spark: SparkSession, sf: str) -> DataFrame:
    orders = spread(table(spark, sf, "orders"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    year = F.year("o_orderdate")
    rows = orders.join(names, "o_custkey").join(sizes, "o_orderkey", "left")
    artist = F.concat(F.when(F.col("c_mktsegment") == "MACHINERY", "DJ ").otherwise(""), "c_name")
    title = F.concat(choose("o_orderpriority", TITLE_OF_PRIORITY), F.lit(" "), F.col("o_orderkey").cast("string"))
    return rows.select(
        F.concat(artist, F.lit("|"), title).alias("album_key"), artist.alias("artist"), title.alias("album"),
        F.filter(F.array(raw_genre()), lambda g: g != "").alias("genres"),
        F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("track_count"),
        F.coalesce("quantity", F.lit(0.0)).alias("total_duration"), year.alias("year"),
        F.concat(F.lit("/lib/"), "c_mktsegment", F.lit("/"), choose("o_orderstatus", DIR_OF_STATUS), F.lit("/"),
                 year.cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".mp3")).alias("file_path"),
        raw_genre().alias("genre"), (F.col("o_orderstatus") == "F").alias("has_artwork"))


def rough_albums(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the gaps that metadata has: blank, missing and repeated names."""
    orders = table(spark, sf, "orders")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.join(names, "o_custkey").select(
        F.col("o_orderkey").cast("string").alias("album_key"),
        F.when(p == "1-URGENT", "  ").when(p == "2-HIGH", F.lit(None).cast("string")).otherwise(F.col("c_name"))
        .alias("artist"),
        F.when(s == "F", F.lit(None).cast("string")).when((s == "O") & (p == "3-MEDIUM"), F.col("c_name"))
        .otherwise(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("album"))


# --- tracks and files -------------------------------------------------------

def track_path() -> Column:
    return F.concat(F.lit("/lib/"), "s_name", F.lit("/"), "p_name", F.lit("/"), F.col("l_orderkey").cast("string"),
                    F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
                    F.lit("."), choose("l_returnflag", EXT_OF_FLAG))


def lines(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The lines, or ``rows`` made of them, with the names of their part and supplier."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    rows = spread(table(spark, sf, "lineitem")) if rows is None else rows
    return rows.join(part, "l_partkey").join(supplier, "l_suppkey")


def order_tracks(spark: SparkSession, sf: str) -> DataFrame:
    unnamed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return lines(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("album_key"), F.col("l_linenumber").alias("track_number"),
        F.when(unnamed, " ").otherwise(F.col("p_name")).alias("title"), F.col("s_name").alias("artist"),
        F.col("l_quantity").alias("duration"), track_path().alias("file_path"),
        choose("p_type", GENRE_OF_TYPE).alias("genre"), F.col("l_shipdate").alias("shipped"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return order_tracks(spark, sf).select("album_key", "file_path")


VORBIS = {"title": "TITLE", "artist": "ARTIST", "album": "ALBUM", "album_artist": "ALBUMARTIST", "year": "DATE",
          "genre": "GENRE", "track_number": "TRACKNUMBER", "compilation": "COMPILATION"}
ID3 = {"title": "TIT2", "artist": "TPE1", "album": "TALB", "album_artist": "TPE2", "year": "TDRC", "genre": "TCON",
       "track_number": "TRCK", "compilation": "TCMP"}
MP4 = {"title": "©nam", "artist": "©ART", "album": "©alb", "album_artist": "aART", "year": "©day", "genre": "©gen",
       "track_number": "trkn"}


def tag_bags(spark: SparkSession, sf: str) -> DataFrame:
    """Tag bags in three formats, chosen by return flag."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus")
    value = {
        "title": F.col("p_name"), "artist": F.col("s_name"),
        "album": F.when(F.col("l_tax") == 0, "").otherwise(F.col("p_brand")),
        "album_artist": F.when(F.col("l_linestatus") == "O", F.col("s_name")).otherwise(""),
        "year": F.date_format("o_orderdate", "yyyy-MM-dd"), "genre": choose("p_type", GENRE_OF_TYPE),
        "track_number": F.concat(F.col("l_linenumber").cast("string"), F.lit("/12")),
        "compilation": F.when(F.col("o_orderstatus") == "P", "Yes").otherwise("0"),
    }

    def bag(names: dict[str, str]) -> Column:
        return F.create_map(*[x for k, n in names.items() for x in (F.lit(n), F.array(value[k]))])
    tags = (F.when(F.col("l_returnflag") == "A", bag(VORBIS)).when(F.col("l_returnflag") == "N", bag(ID3))
            .otherwise(bag(MP4)))
    technical = F.struct(F.lit(320).alias("bitrate"), F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"),
                         F.col("l_quantity").alias("duration"), F.col("l_orderkey").alias("file_size"))
    # keys and numbers meet the orders; the names, which are wider, come after that
    rows = spread(table(spark, sf, "lineitem")).join(orders, "l_orderkey")
    return lines(spark, sf, rows).select(
        track_path().alias("file_path"), tags.alias("tags"), technical.alias("technical"))


# --- registry snapshots -----------------------------------------------------

def shipped_tracks(spark: SparkSession, sf: str, before: str | None = None, since: str | None = None) -> DataFrame:
    rows = order_tracks(spark, sf)
    if before:
        rows = rows.where(F.col("shipped") < F.lit(before).cast("timestamp_ntz"))
    if since:
        rows = rows.where(F.col("shipped") >= F.lit(since).cast("timestamp_ntz"))
    return rows


OLD_SCAN_BEFORE, NEW_SCAN_SINCE = "1999-01-01", "1996-06-01"


# --- events as votes, results, cache ---------------------------------------

def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and event type: the source's genres, confidence and weight."""
    return (table(spark, sf, "events")
            .groupBy(F.col("user_id").cast("string").alias("entity_key"), "event_type")
            .agg(F.array_sort(F.collect_set(F.concat(F.lit("style "), F.floor(_k() / 4).cast("string")))).alias("genres"),
                 F.max(F.least("value", F.lit(100.0))).alias("confidence"))
            .select("entity_key", choose("event_type", SOURCE_OF_EVENT).alias("source"), "genres", "confidence",
                    choose("event_type", WEIGHT_OF_EVENT).alias("weight")))


def vote_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All customers, most of which no source knows, and all users."""
    return (table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity_key"))
            .union(table(spark, sf, "events").select(F.col("user_id").cast("string"))).distinct())


def job_results(spark: SparkSession, sf: str) -> DataFrame:
    status = choose("event_type", STATUS_OF_EVENT)
    style = F.concat(F.lit("x"), (_k() % 3).cast("string"))
    original = F.array(F.concat(F.lit("g"), (_k() % 10).cast("string")))
    confidence = F.least("value", F.lit(100.0))
    reason = F.when(status == "needs_review", F.concat(
        F.lit('Artist: "user '), F.col("user_id").cast("string"), F.lit('" → "User #'),
        F.col("user_id").cast("string"), F.lit('" ('), F.round(confidence, 0).cast("int").cast("string"), F.lit(".0%)")))
    return table(spark, sf, "events").select(
        F.concat(F.lit("job_"), (F.col("user_id") % 10).cast("string")).alias("job_id"),
        F.col("user_id").cast("string").alias("album_key"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("artist"),
        F.concat(F.lit("album "), F.col("user_id").cast("string")).alias("album"),
        original.alias("original_genres"),
        F.array(F.concat(F.lit("G"), (_k() % 7).cast("string")), style).alias("suggested_genres"),
        F.when(status.isin("completed", "approved"), F.concat(original, F.array(style))).otherwise(original)
        .alias("final_genres"),
        confidence.alias("confidence"), F.array(F.lit("spotify")).alias("sources_used"),
        F.when(status == "completed", _k() % 3).otherwise(0).alias("files_updated"), status.alias("status"),
        F.when(status == "failed", "lookup failed").alias("error_message"), F.lit(1.0).alias("processing_time"),
        reason.alias("manual_review_reason"), utc("ts").alias("created_at"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "events")
            .groupBy(F.concat(F.lit("job_"), (F.col("user_id") % 10).cast("string")).alias("job_id"))
            .agg((F.count(F.lit(1)) + F.count_if(F.col("event_type") == "click") * 3).alias("total_albums"),
                 F.min(utc("ts")).alias("created_at")))


def user_albums(spark: SparkSession, sf: str) -> DataFrame:
    """All customers as albums named like the users of the events."""
    key = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select(
        key.alias("album_key"), F.concat(F.lit("user "), key).alias("artist"),
        F.concat(F.lit("Album "), key).alias("album"), (F.col("c_nationkey") + 1980).alias("year"),
        F.col("c_mktsegment").alias("genre"), F.lit(10).cast("bigint").alias("track_count"),
        F.col("c_acctbal").alias("total_duration"), F.concat(F.lit("/lib/"), key).alias("file_path"),
        F.array("c_mktsegment").alias("genres"))


def user_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows from the first order to the last order of each customer."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("album_key")).agg(
        F.min(utc("o_orderdate")).alias("first_discovered"), F.max(utc("o_orderdate")).alias("last_scanned"),
        F.count(F.lit(1)).alias("track_count"), F.max("o_totalprice").alias("top"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))
    confidence = F.when(F.col("n_f") > 0, F.least(F.lit(100.0), F.round(F.col("top") / 4500, 2)))
    return o.select(
        "album_key", F.concat(F.lit("user "), "album_key").alias("artist"),
        F.concat(F.lit("Album "), "album_key").alias("album"), "track_count", F.lit("-").alias("file_hash"),
        "first_discovered", "last_scanned", F.when(F.col("n_urgent") > 0, "scanned").alias("scan_status"),
        F.when(F.col("n_f") > 1, "matched").when(F.col("n_f") == 1, "unmatched").alias("match_status"),
        F.when(F.col("n_f") > 1, F.col("last_scanned")).alias("api_match_date"), confidence.alias("confidence"),
        F.when(F.col("n_urgent") > 5, "unreadable file").alias("error_message"),
        F.col("last_scanned").alias("updated_at"))


def cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a cached answer that lives for ten days; sign-ups never expire."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("USER "), F.col("user_id").cast("string")).alias("artist"),
        F.concat(F.lit("album "), F.col("user_id").cast("string")).alias("album"),
        choose("event_type", SOURCE_OF_EVENT).alias("source"),
        F.array(F.concat(F.lit("style "), _k().cast("string"))).alias("genres"),
        F.least("value", F.lit(100.0)).alias("confidence"), choose("event_type", WEIGHT_OF_EVENT).alias("weight"),
        utc("ts").alias("created_at"),
        F.when(F.col("event_type") != "signup", utc("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a candidate a source returned for its part's album."""
    return lines(spark, sf).select(
        F.concat_ws("|", "p_brand", "p_name").alias("entity_key"), choose("l_returnflag", SOURCE_OF_FLAG).alias("source"),
        F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("cand_artist"),
        F.concat("p_name", F.when(F.col("l_linestatus") == "F", " (deluxe)").otherwise("")).alias("cand_title"),
        F.col("l_linenumber").alias("position"))


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as successive states of one album."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("album_key"), F.col("o_orderkey").alias("change_id"),
        utc("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("genre"),
        F.col("o_orderpriority").alias("album"))


# --- the same in SQL --------------------------------------------------------

_RAW = "CASE " + " ".join(f"WHEN o_orderpriority = '{p}' AND o_orderstatus = '{s}' THEN '{g}'"
                          for (p, s), g in RAW_GENRE.items()) + " END"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_ARTIST = "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'DJ ' ELSE '' END || c_name"
_TITLE = f"({_case('o_orderpriority', TITLE_OF_PRIORITY)}) || ' ' || o_orderkey"
_PATH = ("'/lib/' || s_name || '/' || p_name || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '.' || "
         f"({_case('l_returnflag', EXT_OF_FLAG)})")
_STATUS = _case("event_type", STATUS_OF_EVENT)


def _values(rows: list[tuple], names: str) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) v({names})"


SQL: dict[str, str] = {
    "tax_map": _values(sorted(TAX.lookup.items()), "variant, canonical"),
    "tax_valid": _values([(g,) for g in TAX.valid], "genre"),
    "tax_parents": _values([(c, p) for c, ps in TAX.hierarchy.items() for p in ps], "child, parent"),
    "part_albums": f"""
        SELECT p_brand || '|' || p_name AS album_key, p_brand AS artist, p_name AS album,
               list_sort(list(DISTINCT {_case('p_type', GENRE_OF_TYPE)})) AS genres, count(*) AS track_count,
               CAST(sum(p_size) AS DOUBLE) AS total_duration, min(p_size) + 1949 AS year,
               '/lib/' || p_brand || '/' || p_name || ' (' || (min(p_size) + 1949) || ')/01.flac' AS file_path
        FROM part GROUP BY p_brand, p_name""",
    "worn_albums": f"""
        SELECT album_key, CASE WHEN gap <> 1 THEN artist END AS artist,
               CASE gap WHEN 2 THEN ' ' WHEN 3 THEN artist ELSE album END AS album,
               CASE WHEN artist IN ({", ".join(f"'{a}'" for a in BARE_ARTISTS)}) AND gap >= 10 THEN CAST([] AS VARCHAR[])
                    {" ".join(f"WHEN gap = {k} THEN list_append(genres, '{v}')" for k, v in ODD_CATEGORIES.items())}
                    ELSE genres END AS genres, track_count
        FROM (SELECT *, CAST(total_duration AS BIGINT) % 20 AS gap FROM part_albums)""",
    "order_albums": f"""
        SELECT {_ARTIST} || '|' || {_TITLE} AS album_key, {_ARTIST} AS artist, {_TITLE} AS album,
               list_filter([{_RAW}], lambda g: g <> '') AS genres, coalesce(n_lines, 0) AS track_count,
               coalesce(quantity, 0) AS total_duration, CAST(year(o_orderdate) AS INTEGER) AS year,
               '/lib/' || c_mktsegment || '/' || ({_case('o_orderstatus', DIR_OF_STATUS)}) || '/' || year(o_orderdate)
               || '/' || o_orderkey || '.mp3' AS file_path, {_RAW} AS genre, o_orderstatus = 'F' AS has_artwork
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) l
               ON l_orderkey = o_orderkey""",
    "rough_albums": """
        SELECT CAST(o_orderkey AS VARCHAR) AS album_key,
               CASE o_orderpriority WHEN '1-URGENT' THEN '  ' WHEN '2-HIGH' THEN NULL ELSE c_name END AS artist,
               CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'
                    THEN c_name ELSE 'Order ' || o_orderkey END AS album
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lines": """SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "order_tracks": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS album_key, l_linenumber AS track_number,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN ' ' ELSE p_name END AS title,
               s_name AS artist, l_quantity AS duration, {_PATH} AS file_path,
               {_case('p_type', GENRE_OF_TYPE)} AS genre, l_shipdate AS shipped
        FROM lines""",
    "votes": f"""
        SELECT CAST(user_id AS VARCHAR) AS entity_key, {_case('event_type', SOURCE_OF_EVENT)} AS source,
               list_sort(list(DISTINCT 'style ' || ({_K} // 4))) AS genres, max(least(value, 100)) AS confidence,
               any_value({_case('event_type', WEIGHT_OF_EVENT)}) AS weight
        FROM events GROUP BY user_id, event_type""",
    "vote_entities": """
        SELECT CAST(c_custkey AS VARCHAR) AS entity_key FROM customer
        UNION SELECT CAST(user_id AS VARCHAR) FROM events""",
    "job_results": f"""
        SELECT 'job_' || (user_id % 10) AS job_id, CAST(user_id AS VARCHAR) AS album_key, 'user ' || user_id AS artist,
               'album ' || user_id AS album, ['g' || ({_K} % 10)] AS original_genres,
               ['G' || ({_K} % 7), 'x' || ({_K} % 3)] AS suggested_genres,
               CASE WHEN event_type IN ('click', 'purchase') THEN ['g' || ({_K} % 10), 'x' || ({_K} % 3)]
                    ELSE ['g' || ({_K} % 10)] END AS final_genres,
               least(value, 100) AS confidence, CASE WHEN event_type = 'click' THEN {_K} % 3 ELSE 0 END AS files_updated,
               {_STATUS} AS status, ts AS created_at,
               CASE WHEN event_type = 'view' THEN 'Artist: "user ' || user_id || '" → "User #' || user_id || '" ('
                    || CAST(round(least(value, 100)) AS INTEGER) || '.0%)' END AS manual_review_reason
        FROM events""",
    "jobs": """
        SELECT 'job_' || (user_id % 10) AS job_id,
               count(*) + 3 * count(*) FILTER (event_type = 'click') AS total_albums, min(ts) AS created_at
        FROM events GROUP BY 1""",
    "user_albums": """
        SELECT CAST(c_custkey AS VARCHAR) AS album_key, 'user ' || c_custkey AS artist, 'Album ' || c_custkey AS album,
               c_nationkey + 1980 AS year, c_mktsegment AS genre, CAST(10 AS BIGINT) AS track_count,
               c_acctbal AS total_duration, '/lib/' || c_custkey AS file_path, [c_mktsegment] AS genres
        FROM customer""",
    "user_registry": """
        SELECT album_key, 'user ' || album_key AS artist, 'Album ' || album_key AS album, track_count,
               first_discovered, last_scanned, CASE WHEN n_urgent > 0 THEN 'scanned' END AS scan_status,
               CASE WHEN n_f > 1 THEN 'matched' WHEN n_f = 1 THEN 'unmatched' END AS match_status,
               CASE WHEN n_f > 1 THEN last_scanned END AS api_match_date,
               CASE WHEN n_f > 0 THEN least(100::double, round(top / 4500, 2)) END AS confidence,
               CASE WHEN n_urgent > 5 THEN 'unreadable file' END AS error_message
        FROM (SELECT CAST(o_custkey AS VARCHAR) AS album_key, min(o_orderdate) AS first_discovered,
                     max(o_orderdate) AS last_scanned, count(*) AS track_count, max(o_totalprice) AS top,
                     count(*) FILTER (o_orderstatus = 'F') AS n_f,
                     count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent
              FROM orders GROUP BY o_custkey)""",
    "cache_rows": f"""
        SELECT 'USER ' || user_id AS artist, 'album ' || user_id AS album,
               {_case('event_type', SOURCE_OF_EVENT)} AS source, ['style ' || {_K}] AS genres,
               least(value, 100) AS confidence, {_case('event_type', WEIGHT_OF_EVENT)} AS weight, ts AS created_at,
               CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 10 DAYS END AS expires_at
        FROM events""",
    "candidates": f"""
        SELECT p_brand || '|' || p_name AS entity_key, {_case('l_returnflag', SOURCE_OF_FLAG)} AS source,
               'Brand#' || s_nationkey AS cand_artist,
               p_name || CASE WHEN l_linestatus = 'F' THEN ' (deluxe)' ELSE '' END AS cand_title,
               l_linenumber AS position
        FROM lines""",
    "order_log": """
        SELECT CAST(o_custkey AS VARCHAR) AS album_key, o_orderkey AS change_id, o_orderdate AS created_at,
               o_orderstatus AS genre, o_orderpriority AS album FROM orders""",
}

TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), "
             "lambda x: upper(x[1]) || lower(x[2:])), '')")


def title_sql(text: str) -> str:
    return TITLE_SQL.format(text)


def clean_sql(raw: str) -> str:
    text = rf"regexp_replace(trim({raw}), '\s+', ' ', 'g')"
    text = rf"regexp_replace({text}, '^(The|A|An)\s+', '', 'i')"
    text = rf"regexp_replace({text}, '\s+(Music|Genre)$', '', 'i')"
    text = rf"regexp_replace(replace(replace({text}, '&', 'and'), '/', ' '), '[^\w\s-]', '', 'g')"
    return title_sql(text)


def names_sql(source: str, column: str) -> dict[str, str]:
    """Expressions: canonical name of each distinct value of a column, as table ``canon(raw, cleaned, canonical)``."""
    return {
        "canon_raw": f"SELECT DISTINCT {column} AS raw, {clean_sql(column)} AS cleaned FROM {source}",
        "canon": """
            SELECT raw, cleaned, CASE WHEN raw = '' THEN '' ELSE coalesce(
                (SELECT max(canonical) FROM tax_map WHERE variant = lower(trim(raw))),
                (SELECT max(canonical) FROM tax_map WHERE variant = lower(cleaned)),
                CASE WHEN trim(cleaned) = '' THEN '' END,
                (SELECT arg_min(genre, lpad(CAST(1000 - length(genre) AS VARCHAR), 4, '0') || genre) FROM tax_valid
                 WHERE contains(lower(cleaned), lower(genre))),
                (SELECT arg_min(genre, lpad(CAST(length(genre) AS VARCHAR), 4, '0') || genre) FROM tax_valid
                 WHERE contains(lower(genre), lower(cleaned))),
                cleaned) END AS canonical
            FROM canon_raw""",
    }


def lists_sql(albums: str, key: str = "album_key") -> dict[str, str]:
    """Expressions: normalised list of each album in long form, as table ``norm_list(album_key, genre)``."""
    return {
        "items": f"""
            SELECT DISTINCT {key} AS album_key, trim(x) AS item
            FROM (SELECT {key}, unnest(string_split(g, ';')) AS x
                  FROM (SELECT {key}, unnest(genres) AS g FROM {albums})) WHERE trim(x) <> ''""",
        **names_sql("items", "item"),
        "known": """SELECT DISTINCT album_key, canonical AS genre FROM items JOIN canon ON item = raw
                    WHERE canonical <> ''""",
        "norm_list": """
            SELECT album_key, min(genre) AS genre
            FROM (SELECT album_key, genre FROM known
                  UNION SELECT album_key, parent FROM known JOIN tax_parents ON child = genre)
            GROUP BY album_key, lower(genre)""",
    }


def with_sql(query: str, extra: dict[str, str] | None = None) -> str:
    """The query with every definition it uses, directly or through another, in front."""
    known = {**SQL, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name, body in known.items():
            if name not in order and re.search(rf"\b{name}\b", text) and body is not text:
                need(body)
                if name not in order:
                    order.append(name)
    need(query)
    if not order:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in order) + "\n" + query


def schemas_registry() -> str:
    from shelfmark import schemas
    return schemas.REGISTRY
