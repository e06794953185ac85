"""What is shuffled: narrow rows, and each of them once."""

import re

from pyspark.sql import functions as F

from shelfmark.llm import queries as lq
from shelfmark.operators import albums as al
from suite import bindings as b
from tests.conftest import SF


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_lines_meet_orders_before_names(spark):
    depth = {x.group(1): len(line) - len(line.lstrip(" :+-")) for line in plan(b.tag_bags(spark, SF)).splitlines()
             if "Relation" in line and (x := re.search(r"\[(o_orderkey|s_suppkey|p_partkey)", line))}
    assert depth["o_orderkey"] > depth["p_partkey"] > depth["s_suppkey"]


def test_an_albums_first_path_is_kept_once(spark):
    rows = [("k", "a", "t", 1990, False, "g", 1.0, "/2"), ("k", "b", "u", 1991, True, "h", 2.0, "/1"),
            ("k", "c", "v", 1992, False, "g", 4.0, None), ("n", "d", "w", 1993, False, None, None, None)]
    tracks = spark.createDataFrame(rows, "album_key string, album_artist string, album string, year int, "
                                         "is_compilation boolean, genre string, duration double, file_path string")
    made = al.tracks_to_albums(tracks)
    got = {r.album_key: (r.artist, r.album, r.year, r.genres, r.track_count, r.total_duration, r.file_path) for r in made.collect()}
    assert got == {"k": ("Various Artists", "u", 1991, ["g", "h"], 3, 7.0, "/1"), "n": (None, None, None, [], 1, None, None)}
    assert "min_by" not in plan(made.drop("file_hash"))


def test_consolidated_albums_are_computed_once(spark):
    albums = spark.createDataFrame([("a|t", "a", "t", 1, 1.0, "1"), ("b|t", "b", "t", 2, 5.0, "1"), ("c|t", "c", "t", 1, 1.0, "0"),
                                    ("d|u", "d", "u", 1, 1.0, "1")],
                                   "album_key string, artist string, album string, track_count long, total_duration double, tag string")
    tracks = spark.createDataFrame([("a|t", "/1", 1.0), ("b|t", "/2", 2.0), ("b|t", "/3", None), ("c|t", "/4", 1.0), ("d|u", "/5", 1.0)],
                                   "album_key string, file_path string, duration double")
    made, moved, counters = al.consolidate_compilations(albums, tracks, "tag")
    assert sorted(map(tuple, made.select("album_key", "artist", "track_count", "total_duration").collect())) == [
        ("a|t", "Various Artists", 3, 3.0), ("c|t", "c", 1, 1.0), ("d|u", "d", 1, 1.0)]
    assert sorted((r.file_path, r.album_key) for r in moved.collect()) == [
        ("/1", "a|t"), ("/2", "a|t"), ("/3", "a|t"), ("/4", "c|t"), ("/5", "d|u")]
    assert counters.first().asDict() == {"compilations_found": 3, "albums_consolidated": 1, "tracks_moved": 2, "master_tracks": 3}
    assert "LogicalRDD" not in plan(made.drop("track_count", "total_duration"))  # all from the written albums


def test_replies_are_joined_together_once(spark):
    made = lq.quoted_conversations(spark, SF)
    assert all("answered" not in line for line in plan(made).splitlines())
    assert made.where(F.col("n_linked") > 0).count() > 0
