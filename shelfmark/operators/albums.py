"""Tracks to albums, library statistics, compilations, file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import tags as tg
from shelfmark.functions.core import col, non_empty, or_empty
from shelfmark.operators.common import one_row, percent
from shelfmark.refdata import AUDIO_EXTENSIONS, VARIOUS_ARTISTS, extension_df
from shelfmark.session import materialize


def extract_tracks(raw: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Tag bags to typed track rows with their album key; invalid tracks are kept apart by ``valid_tracks``.

    ``raw``: file_path, tags, technical.
    """
    known = raw.select("file_path", "tags", "technical", tg.non_empty_tags("tags").alias("known"))
    read = known.select("file_path", "tags", "technical",
                        *[c.alias(name) for name, c in tg.attributes("known", aliases).items()])
    read = read.withColumn("is_compilation", tg.is_compilation("compilation")).withColumn(
        "album_artist", tg.album_artist("artist", "album_artist", F.col("is_compilation")))
    return read.select(
        tg.album_key("album_artist", "album", "is_compilation").alias("album_key"),
        "track_number", "title", "artist", "album", "album_artist", "genre", "year", "is_compilation",
        F.coalesce(F.col("technical.duration"), F.lit(0.0)).alias("duration"),
        "file_path", tg.file_format("file_path").alias("file_format"),
        F.coalesce(F.col("technical.file_size"), F.lit(0).cast("bigint")).alias("file_size"),
        tg.raw_metadata(F.upper(tg.file_format("file_path")), "tags", "technical").alias("raw_metadata"))


def valid_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks with an album title and an album artist."""
    return tracks.where(tg.valid_track("album", "album_artist"))


def path_fingerprint(path: Column | str) -> list[Column]:
    """Aggregates that together identify a set of paths without collecting it.

    Sums of two 60-bit slices of each path's md5 plus the count. Sums combine
    map-side, so an album holding a third of all files costs one row per task.
    """
    digest = F.md5(col(path).cast("binary"))

    def piece(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)"))
    return [F.count(col(path)).alias("n_paths"), piece(1).alias("hash_hi"), piece(16).alias("hash_lo")]


def fingerprint_text(n: Column | str, hi: Column | str, lo: Column | str) -> Column:
    return F.md5(F.concat_ws("-", col(n).cast("string"), col(hi).cast("string"), col(lo).cast("string")).cast("binary"))


def tracks_to_albums(tracks: DataFrame) -> DataFrame:
    """One row per album key.

    Only bounded aggregates are taken per album: counts, sums, the set of
    distinct genre strings, attributes of the first track by path. Tracks stay
    in long form (``album_tracks``); a list of them would put one wide album
    into one task.
    """
    first = F.min(F.when(F.col("file_path").isNotNull(), F.struct(  # the path is kept once, as what comes first
        F.col("file_path"), tg.display_artist("album_artist", "is_compilation").alias("artist"), F.col("album"),
        F.col("year"), F.col("is_compilation"))))
    return (tracks.groupBy("album_key")
            .agg(first.alias("f"),
                 F.array_sort(F.collect_set(non_empty("genre"))).alias("genres"),
                 F.count(F.lit(1)).alias("track_count"),
                 F.sum("duration").alias("total_duration"),
                 *path_fingerprint("file_path"))
            .select("album_key", "f.artist", "f.album", "f.year", "genres", "track_count", "total_duration",
                    "f.file_path", "f.is_compilation",
                    fingerprint_text("n_paths", "hash_hi", "hash_lo").alias("file_hash")))


def album_genres(tracks: DataFrame) -> DataFrame:
    """Distinct (album_key, genre) pairs."""
    return tracks.where(or_empty("genre") != "").select("album_key", "genre").distinct()


def album_paths_hash(tracks: DataFrame) -> DataFrame:
    """Path-set fingerprint per album."""
    return (tracks.groupBy("album_key").agg(*path_fingerprint("file_path"))
            .select("album_key", F.col("n_paths").alias("track_count"),
                    fingerprint_text("n_paths", "hash_hi", "hash_lo").alias("file_hash")))


def album_totals(tracks: DataFrame) -> DataFrame:
    """Track count and summed duration per album."""
    return tracks.groupBy("album_key").agg(
        F.count(F.lit(1)).alias("track_count"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"))


def library_stats(albums: DataFrame) -> DataFrame:
    """One row: albums, tracks, albums with genres and their share, distinct genres."""
    has = F.size("genres") > 0
    counts = albums.agg(F.count(F.lit(1)).alias("total_albums"),
                        F.coalesce(F.sum("track_count"), F.lit(0)).cast("bigint").alias("total_tracks"),
                        F.count_if(has).alias("albums_with_genres"))
    vocabulary = (albums.select(F.explode("genres").alias("genre")).agg(F.count_distinct("genre").alias("unique_genres")))
    return one_row(counts, vocabulary).withColumn(
        "genre_coverage", percent(F.col("albums_with_genres"), F.col("total_albums")))


def genre_distribution(albums: DataFrame, top: int | None = None) -> DataFrame:
    """Albums per genre, largest first; ``top`` keeps the first n."""
    counts = albums.select(F.explode("genres").alias("genre")).groupBy("genre").agg(
        F.count(F.lit(1)).alias("n_albums"))
    return counts.orderBy(F.desc("n_albums"), "genre").limit(top) if top else counts


def album_tracks(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """Tracks with their album's attributes, ready to be sorted for display."""
    return tracks.select("album_key", "track_number", "title", F.col("artist").alias("track_artist"), "duration",
                         "file_path").join(albums.select("album_key", "artist", "album"), "album_key")


def ordered_tracks(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """Album page order: track number, then title, then path."""
    return album_tracks(tracks, albums).orderBy("album_key", "track_number", "title", "file_path")


def consolidate_compilations(albums: DataFrame, tracks: DataFrame, tag: Column | str
                             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge albums tagged as compilations that share a title.

    Returns (albums, tracks, counters). The smallest album key of a title
    becomes the master; its artist is Various Artists and its totals are
    recomputed from the re-pointed tracks. The albums feed several branches and
    are written to the shared folder once.
    """
    albums = materialize(albums, "albums")
    flagged = albums.where(tg.is_compilation(tag))
    groups = flagged.groupBy("album").agg(F.min("album_key").alias("master_key"), F.count(F.lit(1)).alias("entries"))
    moves = (flagged.select("album", "album_key").join(groups.where("entries > 1"), "album")
             .select("album_key", "master_key"))
    new_tracks = (tracks.join(moves, "album_key", "left")
                  .withColumn("album_key", F.coalesce("master_key", "album_key")).drop("master_key"))
    # a row an album meets the moves, not a row a track
    sums = tracks.groupBy("album_key").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("seconds"))
    masters = (sums.join(moves, "album_key").withColumn("moved", F.col("master_key") != F.col("album_key"))
               .groupBy(F.col("master_key").alias("album_key"))
               .agg(F.sum("n").alias("new_count"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("new_duration"),
                    F.coalesce(F.sum(F.when(F.col("moved"), F.col("n"))), F.lit(0)).cast("bigint").alias("tracks_moved")))
    marked = albums.join(moves, "album_key", "left")
    kept = marked.where("master_key IS NULL OR master_key = album_key")
    new_albums = (kept.join(masters.drop("tracks_moved"), "album_key", "left")
                  .withColumn("artist", F.when(F.col("master_key").isNotNull(), F.lit(VARIOUS_ARTISTS))
                              .otherwise(F.col("artist")))
                  .withColumn("track_count", F.when(F.col("master_key").isNotNull(),
                                                    F.coalesce("new_count", F.lit(0).cast("bigint")))
                              .otherwise(F.col("track_count")))
                  .withColumn("total_duration", F.when(F.col("master_key").isNotNull(),
                                                       F.coalesce("new_duration", F.lit(0.0)))
                              .otherwise(F.col("total_duration")))
                  .drop("master_key", "new_count", "new_duration"))
    counters = one_row(
        groups.agg(F.coalesce(F.sum("entries"), F.lit(0)).cast("bigint").alias("compilations_found"),
                   F.coalesce(F.sum(F.when(F.col("entries") > 1, F.col("entries") - 1)), F.lit(0))
                   .cast("bigint").alias("albums_consolidated")),
        masters.agg(F.coalesce(F.sum("tracks_moved"), F.lit(0)).cast("bigint").alias("tracks_moved"),
                    F.coalesce(F.sum("new_count"), F.lit(0)).cast("bigint").alias("master_tracks")))
    return new_albums, new_tracks, counters


def scan_tracks(files: DataFrame) -> DataFrame:
    """Audio files of a listing."""
    return files.where(tg.suffix("file_path").isin(AUDIO_EXTENSIONS))


def classify_files(files: DataFrame) -> DataFrame:
    """Each file with its suffix, class and whether a playlist clean-up would remove it.

    A suffix known as media is never removable.
    """
    ext = extension_df(files.sparkSession).groupBy("ext").agg(
        F.bool_or(F.col("class") == "playlist").alias("p"), F.bool_or(F.col("class") == "media").alias("m"))
    return (files.withColumn("ext", tg.suffix("file_path")).join(F.broadcast(ext), "ext", "left")
            .withColumn("class", F.when(F.col("m"), "media").when(F.col("p"), "playlist").otherwise("other"))
            .withColumn("removable", F.coalesce(F.col("p") & ~F.col("m"), F.lit(False))).drop("p", "m"))


def file_inventory(files: DataFrame) -> DataFrame:
    """Files per suffix and class."""
    return classify_files(files).groupBy("ext", "class").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("removable").alias("n_removable"))
