"""Registry and cache as keyed state, and the counters of batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import registry as rg
from shelfmark.operators.albums import fingerprint_text, path_fingerprint
from shelfmark.streaming import progress as sp
from shelfmark.streaming import registry as sr

T = dt.datetime(2024, 1, 1, 12, 0)
FILES = "album_key string, artist string, album string, file_path string, seen_at timestamp"
ANSWERS = "artist string, album string, source string, genres array<string>, confidence double, weight double, created_at timestamp"


def arrive(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).parquet(f"{folder}/in/*")


@pytest.fixture(scope="module")
def deliveries():
    """Four deliveries of files; many paths come again, one album is hot, some rows have nulls."""
    rng = random.Random(2)
    every = [(a, f"artist {a}", f"title {a}", f"/{a}/{n}.mp3") for a in ("hot", "b", "c", "d") for n in range(40 if a == "hot" else 6)]
    out, seen = [], []
    for k in range(4):
        own = rng.sample(every, 14) + rng.sample(seen, min(len(seen), 8))
        own += [own[0], ("e", None, None, None)] if k else [own[0]]
        seen += own
        out.append([(*r, T + dt.timedelta(minutes=10 * k + i)) for i, r in enumerate(own)])
    return out


def test_registry_equals_merging_whole_scans(spark, tmp_path, deliveries):
    registry = spark.createDataFrame([], "album_key string, artist string, album string, file_hash string, "
                                     "first_discovered timestamp, last_scanned timestamp, scan_status string, "
                                     "match_status string, updated_at timestamp")
    want, known = [], []
    for k, rows in enumerate(deliveries):
        files = arrive(spark, tmp_path, k, rows, FILES)
        sr.start_registry(files, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
        known += rows
        # the plain way: every file known so far, grouped again, merged for the albums of this delivery
        whole = spark.createDataFrame(known, FILES).select("album_key", "artist", "album", "file_path").distinct()
        scan = (whole.groupBy("album_key").agg(F.min("artist").alias("artist"), F.min("album").alias("album"),
                                               *path_fingerprint("file_path"))
                .withColumn("file_hash", fingerprint_text("n_paths", F.coalesce("hash_hi", F.lit(0)), F.coalesce(
                    "hash_lo", F.lit(0)))).drop("n_paths", "hash_hi", "hash_lo")
                .join(spark.createDataFrame(rows, FILES).select("album_key").distinct(), "album_key", "left_semi"))
        merged = rg.registry_merge(registry, scan, F.lit(T)).cache()
        want += [(r.album_key, k, r.action, r.file_hash) for r in merged.where("action <> 'absent'").collect()]
        registry = merged.drop("action")
    log = spark.read.parquet(f"{tmp_path}/log").withColumn("h", fingerprint_text("n_paths", "hash_hi", "hash_lo"))
    by_album = {}
    for album, k, action, h in sorted(want, key=lambda x: x[1]):
        by_album.setdefault(album, []).append((action, h))
    got = {}
    for r in sorted(log.collect(), key=lambda r: r.seq):
        got.setdefault(r.album_key, []).append((r.action, r.h))
    assert got == by_album and {a for x in got.values() for a, _ in x} == {"new", "updated", "same"}
    last = {r.album_key: r for r in sr.latest(log, "album_key").collect()}
    for album, r in last.items():
        times = [x[4] for rows in deliveries for x in rows if x[0] == album]
        assert (r.first_discovered, r.last_scanned) == (min(times), max(times))


def test_cache_expires_between_two_files(spark, tmp_path):
    def answer(artist, hours, confidence=50.0):
        return (artist, "Album", "src", ["rock"], confidence, 1.0, T + dt.timedelta(hours=hours))
    for k, rows in enumerate([[answer("a", 0), answer("b", 0), answer("a", 0, 70.0)], [answer("b", 20)],
                              [answer("c", 30)], [answer("c", 30), answer("b", 1)]]):
        sr.start_cache(arrive(spark, tmp_path, k, rows, ANSWERS), f"{tmp_path}/log", f"{tmp_path}/cp", 24).awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    events = sorted((r.artist, r.seq, r.event, r.confidence, r.created_at) for r in log.collect())
    assert events[:2] == [("a", 1, "stored", 70.0, T), ("a", 2, "expired", 70.0, T)]
    assert [e[:3] for e in events if e[0] == "b"] == [("b", 1, "stored"), ("b", 2, "stored")]
    assert {r.artist for r in sr.live_entries(log).collect()} == {"b", "c"}


def test_late_and_repeated_rows_are_counted(spark, tmp_path):
    schema = "job_id string, album_key string, status string, created_at timestamp, confidence double"

    def row(album, hours):
        return ("j", album, "completed", T + dt.timedelta(hours=hours), 1.0)
    out, cp, table = (f"{tmp_path}/{x}" for x in ("out", "cp", "counters"))
    for k, rows in enumerate([[row("a", 0), row("a", 0), row("b", 0)], [row("c", 2)],
                              [row("late1", 0), row("late2", 0), row("late3", 1), row("d", 3), row("d", 3)]]):
        sp.run_available(sp.first_results(arrive(spark, tmp_path, k, rows, schema)), out, cp, counters=table)
    total = sp.read_counters(spark, table).agg(F.sum("read").alias("read"), F.sum("late").alias("late"),
                                               F.sum("repeated").alias("repeated")).first()
    assert (total.read, total.late, total.repeated) == (9, 3, 2)
    assert sorted(r.album_key for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
    held = [r.held for r in sp.read_counters(spark, table).orderBy("batch_id").collect()]
    assert max(held) <= 3
