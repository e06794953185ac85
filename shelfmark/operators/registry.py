"""Registry of known albums: merge with a new scan, status updates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.common import one_row, percent


def registry_merge(registry: DataFrame, scan: DataFrame, now: Column) -> DataFrame:
    """Registry after a scan, with the ``action`` taken per album.

    new: first seen; updated: other files than before; same: seen again;
    absent: known but not in this scan, left as it was. ``scan``: album_key,
    artist, album, track_count, file_hash.
    """
    old, new = registry.alias("o"), scan.alias("n")
    joined = old.join(new, F.col("o.album_key") == F.col("n.album_key"), "full_outer")
    seen, known = F.col("n.album_key").isNotNull(), F.col("o.album_key").isNotNull()
    changed = seen & known & ~F.col("o.file_hash").eqNullSafe(F.col("n.file_hash"))
    action = (F.when(~known, "new").when(~seen, "absent").when(changed, "updated").otherwise("same"))

    def fresh(name: str, on: Column) -> Column:
        return F.when(on, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)
    scanned = [c for c in scan.columns if c in registry.columns and c not in ("album_key", "artist", "album")]
    set_here = {"album_key", "artist", "album", "first_discovered", "last_scanned", "scan_status", "match_status",
                "updated_at", *scanned}
    rest = [F.col(f"o.{c}").alias(c) for c in registry.columns if c not in set_here]
    return joined.select(
        F.coalesce("o.album_key", "n.album_key").alias("album_key"),
        fresh("artist", ~known), fresh("album", ~known), *[fresh(c, ~known | changed) for c in scanned],
        F.coalesce("o.first_discovered", now).alias("first_discovered"),
        F.when(seen, now).otherwise(F.col("o.last_scanned")).alias("last_scanned"),
        F.when(seen, F.lit("scanned")).otherwise(F.col("o.scan_status")).alias("scan_status"),
        F.coalesce("o.match_status", F.lit("unmatched")).alias("match_status"),
        F.when(seen, now).otherwise(F.col("o.updated_at")).alias("updated_at"), *rest, action.alias("action"))


def merge_counters(merged: DataFrame) -> DataFrame:
    """One row: albums discovered, updated, seen and in the registry."""
    a = F.col("action")
    return merged.agg(F.count_if(a == "new").alias("discovered"), F.count_if(a == "updated").alias("updated"),
                      F.count_if(a != "absent").alias("scanned"), F.count(F.lit(1)).alias("registered"))


MATCH_FIELDS = ["match_status", "matched_genres", "confidence", "api_sources", "error_message"]


def update_match_status(registry: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Registry with the outcome of a matching run; ``updates``: album_key and the match fields.

    Of several updates for an album the one with the highest confidence counts; ties go to the greater fields.
    """
    fields = [c for c in MATCH_FIELDS if c in updates.columns]
    order = sorted(fields, key=lambda c: c != "confidence")
    new = updates.groupBy("album_key").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("u"))
    joined = registry.join(new, "album_key", "left")
    hit = F.col("u").isNotNull()
    changed = {c: F.when(hit, F.col(f"u.{c}")).otherwise(F.col(c)) for c in fields}
    stamps = {c: F.when(hit, now).otherwise(F.col(c)) for c in ("api_match_date", "updated_at") if c in registry.columns}
    return joined.withColumns({**changed, **stamps}).drop("u")


def registry_summary(registry: DataFrame) -> DataFrame:
    """Albums by scan status, by match status and in total, with their share."""
    sets = registry.select(F.coalesce("scan_status", F.lit("unknown")).alias("scan_status"),
                           F.coalesce("match_status", F.lit("unknown")).alias("match_status"))
    counted = sets.groupingSets([[], ["scan_status"], ["match_status"]], "scan_status", "match_status").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("scan_status").alias("gs"), F.grouping("match_status").alias("gm"))
    return counted.select(
        F.when((F.col("gs") == 1) & (F.col("gm") == 1), "total").when(F.col("gs") == 0, "scan_status")
        .otherwise("match_status").alias("dimension"),
        F.coalesce("scan_status", "match_status", F.lit("all")).alias("status"), "n")


def registry_totals(registry: DataFrame) -> DataFrame:
    """One row: albums, high-confidence ones, last scan and last match."""
    return registry.agg(F.count(F.lit(1)).alias("total_albums"),
                        F.count_if(F.col("confidence") >= 95).alias("high_confidence"),
                        F.max("last_scanned").alias("last_scan"), F.max("api_match_date").alias("last_match"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Results per status; a missing status counts as unknown."""
    return (results.groupBy(F.coalesce("status", F.lit("unknown")).alias("status"))
            .agg(F.count(F.lit(1)).alias("n")))


def albums_summary(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: albums, with genre, with artwork, tracks."""
    artwork = F.col("has_artwork") if "has_artwork" in albums.columns else F.lit(False)
    genre = F.coalesce(F.col("genre"), F.lit("")) != ""
    return one_row(albums.agg(F.count(F.lit(1)).alias("total_albums"), F.count_if(genre).alias("albums_with_genres"),
                              F.count_if(artwork).alias("albums_with_artwork")),
                   tracks.agg(F.count(F.lit(1)).alias("total_tracks")))


def albums_by_status(registry: DataFrame, scan_status: str | None = None, match_status: str | None = None,
                     limit: int = 100) -> DataFrame:
    """Registry rows of a status pair, last scanned first."""
    out = registry
    if scan_status:
        out = out.where(F.col("scan_status") == scan_status)
    if match_status:
        out = out.where(F.col("match_status") == match_status)
    return out.orderBy(F.desc("last_scanned"), "album_key").limit(limit)


def unmatched_albums(registry: DataFrame, limit: int = 100) -> DataFrame:
    return albums_by_status(registry, match_status="unmatched", limit=limit)


def album_details(registry: DataFrame, album_key: str) -> DataFrame:
    return registry.where(F.col("album_key") == album_key)


def recommendations(registry: DataFrame, results: DataFrame, albums: DataFrame) -> DataFrame:
    """Advice rows: unmatched albums, open reviews, genre coverage under 80 %."""
    facts = one_row(
        registry.agg(F.count_if(F.col("match_status") == "unmatched").alias("unmatched")),
        results.agg(F.count_if(F.col("status") == "needs_review").alias("reviews")),
        albums.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("genres") > 0).alias("with_genres")))
    share = percent(F.col("with_genres"), F.col("n"))
    advice = F.array(
        F.when(F.col("unmatched") > 0, F.struct(F.lit("unmatched").alias("topic"), F.format_string(
            "%s albums haven't been matched yet", F.format_number("unmatched", 0)).alias("advice"))),
        F.when(F.col("reviews") > 0, F.struct(F.lit("review").alias("topic"), F.format_string(
            "%d albums need manual review", "reviews").alias("advice"))),
        F.when((F.col("n") > 0) & (share < 80), F.struct(F.lit("coverage").alias("topic"), F.format_string(
            "Only %.1f%% of albums have genres", share).alias("advice"))))
    return facts.select(F.explode(F.filter(advice, lambda x: x.isNotNull())).alias("r")).select("r.*")


def source_status(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Which catalogue tables exist."""
    rows = [(t, spark.catalog.tableExists(t)) for t in tables]
    return spark.createDataFrame(rows, "table string, available boolean")
