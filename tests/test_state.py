"""Ordered computations, stores, registry, history, streams."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import albums as al
from shelfmark.operators import history as hs
from shelfmark.operators import jobs as jb
from shelfmark.operators import registry as rg
from shelfmark.operators.ordered import numbered, ranged, sum_before, trailing_count, with_previous
from shelfmark.plans import enrich, quality_report, register
from shelfmark.refdata import Taxonomy
from shelfmark.sources import cache as ch
from shelfmark.sources import config, store, tracks
from shelfmark.streaming import progress as sp
from suite import bindings as b
from tests.conftest import SF

TAX = Taxonomy.default()


def log(spark, n=400):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 9)}", 1_700_000_000 + rnd.randint(0, 400_000), i,
             rnd.choice(["a", "b", None])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, s long, id int, v string").withColumn(
        "ts", F.timestamp_seconds("s"))


def test_order_in_ranges_equals_window(spark):
    df = log(spark).unionByName(spark.createDataFrame(
        [(None, 5, 900, "x"), (None, 4, 901, "y"), ("hot", None, 902, "z")], "k string, s long, id int, v string")
        .withColumn("ts", F.timestamp_seconds("s")))
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {r.id: (r.n, r.p, r.t) for r in df.withColumn("n", F.row_number().over(w)).withColumn("p", F.lag("v").over(w))
            .withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("k"))).collect()}
    for parts in (1, 7):
        got = with_previous(df, "k", "ts", ["id"], "v", "p", number="n", total="t", parts=parts)
        assert got.columns == [*df.columns, "p", "n", "t"]
        assert {r.id: (r.n, r.p, r.t) for r in got.collect()} == want
    assert {r.id: r.n for r in numbered(df, "k", "ts", ["id"], "n").collect()} == {k: v[0] for k, v in want.items()}
    sums = df.withColumn("s", F.coalesce(F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert ({r.id: r.b for r in sum_before(df, "k", ["ts", "id"], "id", "b", 5).collect()}
            == {r.id: r.s for r in sums.collect()})
    assert numbered(df.limit(0), "k", "ts", ["id"]).count() == 0


def test_a_hot_key_in_one_second_takes_many_ranges(spark):
    df = spark.range(6000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id", "id % 5 AS v",
                                      "timestamp_micros(1700000000000000 + IF(id % 3 = 0, id, id * 1000000)) AS ts")
    sizes = [r["count"] for r in ranged(df, "k", ["ts", "id"], 12).where("k = 'hot'").groupBy("_part").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 1000 and len(sizes) >= 4
    got = {r.id: r.n for r in numbered(df, "k", "ts", ["id"], "n", 12).where("k = 'hot'").collect()}
    assert got == {k: k // 3 + 1 for k in range(0, 6000, 3)}


def test_trailing_count_equals_window(spark):
    df = log(spark)
    w = Window.partitionBy("k").orderBy("s").rangeBetween(-3000, 0)
    want = {r.id: r.n for r in df.withColumn("n", F.count(F.lit(1)).over(w)).collect()}
    assert {r.id: r.n for r in trailing_count(df, "k", "ts", 3000, "n").collect()} == want
    odd = spark.createDataFrame([(None, 1, 1), ("a", None, 2), ("a", 7, 3), ("a", 7, 4)], "k string, s long, id int").withColumn(
        "ts", F.timestamp_seconds("s"))
    assert {r.id: r.n for r in trailing_count(odd, "k", "ts", 9, "n", 2).collect()} == {1: None, 2: None, 3: 2, 4: 2}


def scan(spark, rows):
    df = spark.createDataFrame(rows, "album_key string, file_path string")
    return al.album_paths_hash(df).withColumn("artist", F.lit("x")).withColumn("album", F.lit("y"))


def test_registry_is_idempotent(spark):
    now = [F.lit(f"2024-01-0{i}").cast("timestamp") for i in (1, 2, 3)]
    empty = spark.createDataFrame([], schemas.REGISTRY)
    s1, s2 = scan(spark, [("a", "1"), ("b", "1")]), scan(spark, [("a", "1"), ("a", "2"), ("c", "1")])
    r1 = rg.registry_merge(empty, s1, now[0])
    assert rg.merge_counters(r1).first().asDict() == dict(discovered=2, updated=0, scanned=2, registered=2)
    r2 = rg.registry_merge(r1.drop("action"), s2, now[1])
    assert {r.album_key: r.action for r in r2.collect()} == {"a": "updated", "b": "absent", "c": "new"}
    again = rg.merge_counters(rg.registry_merge(r2.drop("action"), s2, now[2])).first()
    assert (again.discovered, again.updated, again.registered) == (0, 0, 3)


def test_store_versions_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "album_key string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "album_key string, n int")
    path = str(tmp_path / "albums")
    assert store.write_version(old, path) == 1
    assert store.write_version(store.upsert(store.read_version(spark, path), new, ["album_key"]), path) == 2
    once = sorted(map(tuple, store.read_version(spark, path).collect()))
    assert once == [("a", 1), ("b", 2), ("c", 2)]
    twice = store.upsert(store.read_version(spark, path), new, ["album_key"])
    assert sorted(map(tuple, twice.collect())) == once
    assert store.read_version(spark, path, 1).count() == 2


def test_config_and_listing(spark, tmp_path):
    config.save_taxonomy(spark, TAX.with_mapping("Q", "Quiet"), str(tmp_path / "tax"))
    assert config.load_taxonomy(spark, str(tmp_path / "tax")).lookup["q"] == "Quiet"
    assert config.load_options(spark)["confidence_threshold"] == 95.0
    music = tmp_path / "music" / "sub"
    music.mkdir(parents=True)
    for name in ("a.mp3", "b.FLAC", "c.txt", "d.m3u"):
        (music / name).write_bytes(b"x")
    found = tracks.list_tracks(spark, str(tmp_path / "music"))
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in found.collect()) == ["a.mp3", "b.FLAC"]
    kinds = {(r.ext, r["class"], r.n_removable) for r in al.file_inventory(tracks.list_files(spark, str(tmp_path / "music"))).collect()}
    assert kinds == {(".mp3", "media", 0), (".flac", "media", 0), (".txt", "other", 0), (".m3u", "playlist", 1)}


def test_cache_expires(spark):
    t = [F.lit(f"2024-01-0{i} 00:00:00").cast("timestamp") for i in (1, 2, 3)]
    votes = spark.createDataFrame([("A", "x", "s", ["g"], 80.0, 1.0)],
                                  "artist string, album string, source string, genres array<string>, confidence double, weight double")
    cache = ch.put(ch.cleared(ch.entries(votes, t[0])), ch.entries(votes, t[0]))
    asked = spark.createDataFrame([("a", "X", "s")], "artist string, album string, source string")
    assert ch.get(cache, asked, t[0]).count() == 1
    assert ch.get(cache, asked, t[2]).count() == 0
    assert ch.put(cache, ch.entries(votes, t[1])).count() == 1


def test_approve_then_revert(spark):
    album = spark.createDataFrame([("k", "old", "t", 2000, "Rock", 3, 1.0, "/p")],
                                  "album_key string, artist string, album string, year int, genre string, track_count long, total_duration double, file_path string")
    result = spark.createDataFrame(
        [("j", "k", "needs_review", ["Pop", "Jazz"], 'Artist: "old" → "New" (80.0%)')],
        "job_id string, album_key string, status string, suggested_genres array<string>, manual_review_reason string"
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    now = F.lit("2024-01-02").cast("timestamp")
    none = spark.createDataFrame([], schemas.VERSIONS)
    albums, results, rows = hs.apply_approvals(album, result, album.select("album_key"), none, now)
    assert (albums.first().artist, albums.first().genre, results.first().status) == ("New", "Pop; Jazz", "approved")
    versions = hs.append_versions(none, rows)
    assert sorted((r.version_number, r.is_current) for r in versions.collect()) == [(0, False), (1, True)]
    back, more = hs.revert(albums, versions, spark.createDataFrame([("k", 0)], "album_key string, version_number long"), now)
    assert (back.first().artist, back.first().genre) == ("old", "Rock")
    final = {r.version_number: r for r in hs.append_versions(versions, more).collect()}
    assert sorted(final) == [0, 1, 2, 3] and [n for n, r in final.items() if r.is_current] == [3]
    assert final[3].reverted_from == 0 and set(final[3].changed_fields) == {"artist", "genre"}


def test_repeated_requests_count_once(spark):
    album = spark.createDataFrame([("k", "old", "t", 2000, "Rock", 3, 1.0, "/p"), ("m", "a", "b", 2000, "Pop", 1, 1.0, "/q")],
                                  "album_key string, artist string, album string, year int, genre string, track_count long, total_duration double, file_path string")
    result = spark.createDataFrame(
        [("j", "k", "needs_review", ["Jazz"], None), ("j", "m", "needs_review", None, "nothing to correct")],
        "job_id string, album_key string, status string, suggested_genres array<string>, manual_review_reason string"
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    now = F.lit("2024-01-02").cast("timestamp")
    none = spark.createDataFrame([], schemas.VERSIONS)
    twice = spark.createDataFrame([("k",), ("k",), ("m",), ("x",)], "album_key string")
    albums, results, rows = hs.apply_approvals(album, result, twice, none, now)
    assert albums.count() == 2
    assert sorted((r.album_key, r.status) for r in results.collect()) == [("k", "approved"), ("m", "needs_review")]
    versions = hs.append_versions(none, rows)
    asked = spark.createDataFrame([("k", 0), ("k", 1), ("k", 0), ("k", 9)], "album_key string, version_number long")
    back, more = hs.revert(albums, versions, asked, now)
    assert back.count() == 2
    assert sorted((r.version_number, r.reverted_from) for r in more.collect() if r.is_current) == [(3, 1)]
    registry = spark.createDataFrame([("k", "new", 0.0)], "album_key string, match_status string, confidence double")
    updates = spark.createDataFrame([("k", "low", 10.0), ("k", "high", 90.0), ("k", "high", 90.0)], registry.schema)
    changed = rg.update_match_status(registry, updates, now).collect()
    assert [(r.match_status, r.confidence) for r in changed] == [("high", 90.0)]


def test_rescan_needs_one_name(spark):
    registry = spark.createDataFrame([(k, "bad") for k in "abcd"], "album_key string, error_message string")
    scan = spark.createDataFrame([("a", "x", None), ("b", None, "y"), ("b", None, "y"), ("c", "", None)],
                                 "album_key string, artist string, album string")
    found = {r.album_key: r.outcome for r in store.retry_outcome(registry, scan).collect()}
    assert found == {"a": "fixed", "b": "fixed", "c": "still_failed", "d": "still_failed"}
    assert store.retry_outcome(registry, scan).count() == 4


def test_malformed_album_name_is_refused(spark):
    with pytest.raises(ValueError):
        jb.specific_album(spark.createDataFrame([("a", "b")], "artist string, album string"), "no comma")


def test_stream_drops_late_rows_and_repeats(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame(rows, "job_id string, album_key string, status string, created_at timestamp, confidence double")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 12, 0)
    put("1", [("j", "a", "completed", t, 1.0), ("j", "a", "completed", t, 1.0)])
    schema = "job_id string, album_key string, status string, created_at timestamp, confidence double"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    sp.run_available(sp.first_results(stream()), out, cp)
    put("2", [("j", "b", "failed", t + dt.timedelta(hours=2), 1.0)])
    sp.run_available(sp.first_results(stream()), out, cp)
    put("3", [("j", "late", "failed", t, 1.0)])
    sp.run_available(sp.first_results(stream()), out, cp)
    assert sorted(r.album_key for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_plans_end_to_end(spark, tmp_path):
    now = b.now()
    registry = register.run_scan(b.tag_bags(spark, SF), spark.createDataFrame([], schemas.REGISTRY), str(tmp_path),
                                 "s1", now, now)
    assert registry.count() > 0 and spark.read.parquet(f"{tmp_path}/scan_sessions").first().status == "completed"
    albums = b.part_albums(spark, SF).limit(40)
    from suite.q_matching import part_votes
    results = enrich.run_job(albums.withColumn("genres", F.array().cast("array<string>")), b.candidates(spark, SF),
                             part_votes(spark, SF), TAX, str(tmp_path / "job"), "j1", "test", now,
                             {"confidence_threshold": 60.0, "max_genres_per_album": 2})
    assert results.count() == 40
    rows = results.collect()
    assert {r.status for r in rows} <= {"completed", "needs_review", "skipped"}
    assert all(len(r.final_genres) <= 2 for r in rows if r.status == "completed")
    job = store.read_log(spark, str(tmp_path / "job"), "jobs", "job_id").first()
    assert (job.job_id, job.confidence_threshold, job.total_albums, job.dry_run) == ("j1", 60.0, 40, True)
    out = quality_report.run_report(albums, None, TAX, str(tmp_path / "q"), "r1", now)
    report = spark.read.parquet(f"{tmp_path}/q/quality_reports").first()
    assert report.total_issues == out["issues"].count()


def test_runs_that_come_again(spark, tmp_path):
    path = str(tmp_path / "log")

    def rows(*values):
        return spark.createDataFrame([(v,) for v in values], "v int")
    store.write_run({"a": rows(1, 2), "b": rows(9)}, path, "run_id", "1")
    store.write_run({"a": rows(3), "b": rows()}, path, "run_id", "2")
    once = sorted(map(tuple, store.read_log(spark, path, "a", "run_id").collect()))
    store.write_run({"a": rows(1, 2), "b": rows(9)}, path, "run_id", "1")
    assert sorted(map(tuple, store.read_log(spark, path, "a", "run_id").collect())) == once == [("1", 1), ("1", 2), ("2", 3)]
    rows(7).withColumns({"run_id": F.lit("3"), "attempt": F.lit("broke off")}).write.mode("append").partitionBy(
        "run_id", "attempt").parquet(f"{path}/a")
    assert store.read_log(spark, path, "a", "run_id").count() == 3
    store.write_run({"a": rows(), "b": rows(4)}, path, "run_id", "1")
    assert [tuple(r) for r in store.read_log(spark, path, "a", "run_id").collect()] == [("2", 3)]
    assert [tuple(r) for r in store.read_log(spark, path, "b", "run_id").collect()] == [("1", 4)]


def test_sources_that_are_off(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    assert enrich.of_enabled(rows, {}).count() == 3
    assert {r.source for r in enrich.of_enabled(rows, {"sources": {"a": {"enabled": False}, "b": {}}}).collect()} == {"b"}
