"""Version history: approvals, rejections, changed fields, reverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.common import latest
from shelfmark.operators.matching import parse_corrections
from shelfmark.operators.ordered import with_previous

SNAPSHOT_FIELDS = ["artist", "album", "year", "genre", "track_count", "total_duration", "file_path"]
RESTORED_FIELDS = ["artist", "album", "year", "genre"]


def changed_fields(old: str, new: str, fields: list[str]) -> Column:
    """Map of the fields that differ between two structs to their old and new value; nulls compare equal."""
    names = F.array(*[F.lit(f) for f in fields])
    pairs = F.array(*[F.struct(F.col(old)[f].cast("string").alias("old"), F.col(new)[f].cast("string").alias("new"))
                      for f in fields])
    return F.map_filter(F.map_from_arrays(names, pairs), lambda _, p: ~p["old"].eqNullSafe(p["new"]))


def versions_of(changes: DataFrame, key: str, ts: str, tie: list[str], fields: list[str]) -> DataFrame:
    """Numbered versions of a change log, with the fields changed since the version before.

    ``is_current`` marks the last one. No window sees a whole key (see
    ``ordered``); number, version before and count of versions come from one pass.
    """
    snap = changes.withColumn("snapshot", F.struct(*fields))
    numbered = with_previous(snap, key, ts, tie, "snapshot", "before", number="version_number", total="_last")
    return (numbered.withColumn("changed_fields", F.when(F.col("before").isNotNull(),
                                                         changed_fields("before", "snapshot", fields)))
            .withColumn("is_current", F.col("version_number") == F.col("_last")).drop("_last", "before"))


def proposed_changes(albums: DataFrame, results: DataFrame) -> DataFrame:
    """Albums with the latest result that proposes something, and the corrections it holds."""
    newest = latest(results, ["album_key"], ["created_at", "job_id"],
                    ["job_id", "confidence", "status", "suggested_genres", "manual_review_reason", "sources_used",
                     "created_at"])
    fix = parse_corrections("manual_review_reason")
    return (albums.join(newest, "album_key", "left").withColumns(fix)
            .withColumn("has_proposal", F.col("job_id").isNotNull()))


def apply_approvals(albums: DataFrame, results: DataFrame, approvals: DataFrame, versions: DataFrame, now: Column
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply approved results. Returns (albums, results, new version rows).

    ``approvals``: album_key; an album named several times is approved once. The
    first change of an album also stores the state before it, as version 0.
    ``versions`` supplies the last number per album. Results of an album that
    has nothing to apply, or that isn't in ``albums``, keep waiting for review.
    """
    waiting = results.where("status = 'needs_review'").join(approvals.select("album_key"), "album_key", "left_semi")
    chosen = latest(waiting, ["album_key"], ["created_at", "job_id"],
                    ["job_id", "suggested_genres", "manual_review_reason"])
    fix = parse_corrections("manual_review_reason")
    updates = chosen.select(
        "album_key", F.col("manual_review_reason").alias("change_reason"),
        fix["corrected_artist"].alias("new_artist"), fix["corrected_album"].alias("new_album"),
        F.nullif(F.array_join("suggested_genres", "; "), F.lit("")).alias("new_genre"))
    joined = albums.join(updates, "album_key", "left")
    fields = {f: F.coalesce(f"new_{f}", f) for f in ("artist", "album", "genre")}
    touched = F.coalesce("new_artist", "new_album", "new_genre").isNotNull()
    new_albums = joined.withColumns(fields).select(*albums.columns)

    after = [fields.get(f, F.col(f)).alias(f) for f in SNAPSHOT_FIELDS]
    numbers = versions.groupBy("album_key").agg(F.max("version_number").alias("last_number"))
    change = (joined.where(touched).select("album_key", "change_reason", F.struct(*SNAPSHOT_FIELDS).alias("old"),
                                           F.struct(*after).alias("new"))
              .join(numbers, "album_key", "left"))
    first = change.where("last_number IS NULL").select(
        "album_key", F.lit(0).cast("bigint").alias("version_number"), F.col("old").alias("snapshot"),
        F.lit(None).cast("map<string,struct<old:string,new:string>>").alias("changed_fields"),
        F.lit("preserved").alias("changed_by"), F.lit("State before the first change").alias("change_reason"),
        F.lit(False).alias("is_current"))
    new = change.select(
        "album_key", (F.coalesce("last_number", F.lit(0)) + 1).alias("version_number"), F.col("new").alias("snapshot"),
        changed_fields("old", "new", ["artist", "album", "genre"]).alias("changed_fields"),
        F.lit("api_match").alias("changed_by"), "change_reason", F.lit(True).alias("is_current"))
    rows = first.unionByName(new).withColumn("created_at", now)
    done = joined.where(touched).select("album_key").distinct().withColumn("approved", F.lit(True))
    new_results = (results.join(done, "album_key", "left")
                   .withColumn("status", F.when(F.col("approved") & (F.col("status") == "needs_review"), "approved")
                               .otherwise(F.col("status"))).select(*results.columns))
    return new_albums, new_results, rows


def apply_rejections(results: DataFrame, rejections: DataFrame) -> DataFrame:
    """Results of rejected albums that waited for review become ``rejected``."""
    done = rejections.select("album_key").distinct().withColumn("rejected", F.lit(True))
    return (results.join(done, "album_key", "left")
            .withColumn("status", F.when(F.col("rejected") & (F.col("status") == "needs_review"), "rejected")
                        .otherwise(F.col("status"))).select(*results.columns))


def append_versions(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """Version table with new rows; albums that got a new current version lose the old flag."""
    moved = rows.where("is_current").select("album_key").distinct().withColumn("_moved", F.lit(True))
    kept = (versions.join(moved, "album_key", "left")
            .withColumn("is_current", F.col("is_current") & F.col("_moved").isNull()).drop("_moved"))
    return kept.unionByName(rows, allowMissingColumns=True)


def next_version_numbers(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """Number the next version of each album will get."""
    last = versions.groupBy("album_key").agg(F.max("version_number").alias("last_number"))
    return (keys.select("album_key").distinct().join(last, "album_key", "left")
            .select("album_key", (F.coalesce("last_number", F.lit(0)) + 1).cast("bigint").alias("next_version")))


def version_history(versions: DataFrame, old_versions: DataFrame | None = None, album_key: str | None = None
                    ) -> DataFrame:
    """Versions with their snapshot fields, newest first; albums without any fall back to the old table."""
    flat = versions.select("album_key", "version_number", *[F.col("snapshot")[f].alias(f) for f in RESTORED_FIELDS],
                           "changed_fields", "changed_by", "change_reason", "created_at", "is_current")
    if old_versions is not None:
        fallback = old_versions.join(versions.select("album_key").distinct(), "album_key", "left_anti")
        flat = flat.unionByName(fallback, allowMissingColumns=True)
    if album_key is not None:
        return flat.where(F.col("album_key") == album_key).orderBy(F.desc("version_number"))
    return flat


def revert(albums: DataFrame, versions: DataFrame, requests: DataFrame, now: Column
           ) -> tuple[DataFrame, DataFrame]:
    """Restore albums to a stored version. Returns (albums, new version rows).

    ``requests``: album_key, version_number. Of several requests for an album
    the one for its highest stored version counts. History only grows: the state
    before the revert is stored, then the restored state as the new current
    version with the number it came from.
    """
    target = (versions.select("album_key", "version_number", F.col("snapshot").alias("target"))
              .join(requests.select("album_key", "version_number"), ["album_key", "version_number"], "left_semi")
              .groupBy("album_key").agg(F.max("version_number").alias("target_number"),
                                        F.max_by("target", "version_number").alias("target")))
    joined = albums.join(target, "album_key", "left")
    hit = F.col("target").isNotNull()
    restored = {f: F.when(hit, F.col("target")[f]).otherwise(F.col(f)) for f in RESTORED_FIELDS}
    new_albums = joined.withColumns(restored).select(*albums.columns)

    numbers = versions.groupBy("album_key").agg(F.max("version_number").alias("last_number"))
    after = [restored.get(f, F.col(f)).alias(f) for f in SNAPSHOT_FIELDS]
    change = (joined.where(hit).select("album_key", "target_number", F.struct(*SNAPSHOT_FIELDS).alias("old"),
                                       F.struct(*after).alias("new"))
              .join(numbers, "album_key"))
    reason = F.concat(F.lit("Reverted to version "), F.col("target_number").cast("string"))
    before = change.select(
        "album_key", (F.col("last_number") + 1).alias("version_number"), F.col("old").alias("snapshot"),
        F.lit(None).cast("map<string,struct<old:string,new:string>>").alias("changed_fields"),
        F.lit("preserved").alias("changed_by"), F.lit("State before revert").alias("change_reason"),
        F.lit(False).alias("is_current"), F.lit(None).cast("bigint").alias("reverted_from"))
    done = change.select(
        "album_key", (F.col("last_number") + 2).alias("version_number"), F.col("new").alias("snapshot"),
        changed_fields("old", "new", RESTORED_FIELDS).alias("changed_fields"),
        F.lit("user_revert").alias("changed_by"), reason.alias("change_reason"), F.lit(True).alias("is_current"),
        F.col("target_number").cast("bigint").alias("reverted_from"))
    return new_albums, before.unionByName(done).withColumn("created_at", now)
