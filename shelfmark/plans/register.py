"""Scan and register: tag bags to tracks, albums and the merged registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from shelfmark.operators import albums as al
from shelfmark.operators import registry as rg
from shelfmark.sources import store


def scan(raw_tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid tracks and the albums they form."""
    tracks = al.valid_tracks(al.extract_tracks(raw_tracks))
    return tracks, al.tracks_to_albums(tracks)


def register(raw_tracks: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Registry after a scan, with the action taken per album."""
    _, albums = scan(raw_tracks)
    return rg.registry_merge(registry, albums.select("album_key", "artist", "album", "track_count", "file_hash"), now)


def run_scan(raw_tracks: DataFrame, registry: DataFrame, path: str, session_id: str, started: Column,
             completed: Column) -> DataFrame:
    """Merge, write the next registry version, log the session; returns the stored registry.

    Counters come from the written rows: the merge runs once.
    """
    spark = raw_tracks.sparkSession
    merged = register(raw_tracks, registry, completed)
    number = store.write_version(merged, f"{path}/registry")
    stored = store.read_version(spark, f"{path}/registry", number)
    store.write_run({"scan_sessions": store.session_row(rg.merge_counters(stored), session_id, started, completed)}, path,
                    "session_id", session_id)
    return stored.drop("action")
