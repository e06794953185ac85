import datetime as dt

from pyspark.sql import functions as F

from shelfmark.operators import jobs as jb
from shelfmark.operators import matching as mt
from shelfmark.operators import progress as pr
from shelfmark.operators import quality as ql
from shelfmark.operators import suggest as sg
from shelfmark.refdata import Taxonomy

TAX = Taxonomy.default()


def albums(spark, rows):
    return spark.createDataFrame(rows, "album_key string, artist string, album string, genres array<string>")


def test_value_rules(spark):
    cases = {" ": {"empty_genre", "unknown_genre"}, "Rock; Pop": {"invalid_characters"}, "Q" * 51: {"too_long", "unknown_genre"},
             "123": {"numeric_only", "unknown_genre"}, "Rock rock": {"duplicate_words"}, "Rock//Pop": {"invalid_format"},
             "Xyzzy": {"unknown_genre"}, "Jazz": set()}
    df = albums(spark, [(k, "a", "t", [k]) for k in cases])
    got = {k: set() for k in cases}
    for r in ql.genre_issues(df, TAX).collect():
        got[r.album_key].add(r.issue_type)
    assert got == cases


def test_artist_rules(spark):
    rows = [("1", "one", "t", [])]
    rows += [(f"two{i}", "two", f"t{i}", []) for i in range(2)]
    rows += [(f"three{i}", "three", f"t{i}", ["Rock"] if i < 2 else []) for i in range(3)]
    rows += [(f"many{i}", "thirteen", f"t{i}", ["Rock"] if i < 10 else []) for i in range(13)]
    rows += [(f"wide{i}", "wide", f"t{i}", [f"Odd{i} One", f"Odd{i} Two"]) for i in range(6)]
    got = {(r.artist, r.issue_type) for r in ql.artist_issues(albums(spark, rows), TAX).collect()}
    assert got == {("three", "missing_genres"), ("wide", "artist_inconsistency")}


def test_scores(spark):
    issue = [("x", s, "", "", "", "", "", 1.0) for s in ["critical"] + ["warning"] * 2 + ["info"] * 4]
    df = spark.createDataFrame(issue, "issue_type string, severity string, album_key string, artist string, album string, description string, suggested_fix string, confidence double")
    lib = albums(spark, [(str(i), "a", "t", ["Rock"] if i else []) for i in range(10)])
    s = ql.scores(lib, df).first()
    assert (s.quality_score, s.consistency_score) == (98.9, 90.0)
    empty = ql.scores(lib.where("false"), df.where("false")).first()
    assert (empty.quality_score, empty.consistency_score) == (100.0, 100.0)


def test_votes(spark):
    votes = spark.createDataFrame([("e", "spotify", ["Rock", "Pop"], 90.0, 1.0), ("e", "deezer", ["rock"], 80.0, 0.75)],
                                  "entity_key string, source string, genres array<string>, confidence double, weight double")
    keys = spark.createDataFrame([("e",), ("none",)], "entity_key string")
    r = {x.entity_key: x for x in mt.aggregate_votes(keys, votes).collect()}
    assert (r["e"].final_genres, r["e"].confidence, r["none"].confidence) == (["Rock", "Pop"], 90.0, 0.0)
    assert r["e"].reasoning == "Aggregated from 2 sources: Rock (deezer, spotify); Pop (spotify)"
    s = {x.genre: x.score for x in mt.vote_scores(votes).collect()}
    assert s == {"Rock": 1.5, "Pop": 0.9}


def test_decisions(spark):
    df = spark.createDataFrame([(c,) for c in (95.0, 94.9, 70.0, 69.9, 40.0, 39.9)], "confidence double")
    out = df.select(jb.decision_status(F.col("confidence")).alias("s"), jb.decision_reason(F.col("confidence")).alias("r")).collect()
    assert [o.s for o in out] == ["completed"] + ["needs_review"] * 4 + ["skipped"]
    assert [(o.r or "-").split()[0] for o in out] == ["-", "Medium", "Medium", "Low", "Low", "Very"]


def test_suggestion_confidence(spark):
    df = spark.createDataFrame([("/x/rock/y", 1), ("/x/rock/jazz/y", 2), ("/rock/jazz/folk/blues", 3), ("/x/1975/y", 2), ("/x/y", 0)],
                               "p string, n int")
    rows = df.select("n", sg.path_suggestion("p", TAX).alias("s")).collect()
    for r in rows:
        assert (r.s is None) == (r.n == 0)
        if r.s:
            assert len(r.s.genres) == r.n and r.s.confidence == min(70, 20 * r.n + 30)
    ctx = spark.createDataFrame([("x", "t", 8, 0), ("x", "t", 3, 1), ("DJ x", "t", 3, 2), ("DJ x", "Live", 3, 3)],
                                "a string, b string, c int, n int")
    for r in ctx.select("n", sg.context_suggestion("a", "b", "c", TAX).alias("s")).collect():
        assert (r.s is None) if r.n == 0 else r.s.confidence == {1: 35, 2: 50, 3: 60}[r.n]


def test_combined_suggestion(spark):
    rows = [([(["Rock", "Pop"], 80.0, "r", "artist"), (["Jazz", "Rock"], 50.0, "r", "path")],), ([],), ([(["Rock"], 5.0, "r", "x")],)]
    df = spark.createDataFrame(rows, f"s array<{sg.SUGGESTION}>")
    a, none, weak = [r.x for r in df.select(sg.combine_suggestions("s").alias("x")).collect()]
    assert (a.genres, a.confidence) == (["Rock", "Pop", "Jazz"], 65.0) and none is None and weak is None


def test_time_texts(spark):
    now = dt.datetime(2024, 1, 1, 12)
    cases = {30: "just now", 60: "1 min ago", 3599: "59 mins ago", 3600: "1 hour ago", 7300: "2 hours ago"}
    df = spark.createDataFrame([(s, now - dt.timedelta(seconds=s)) for s in cases], "s int, t timestamp")
    got = {r.s: r.x for r in df.select("s", pr.relative_time(F.col("t"), F.lit(now)).alias("x")).collect()}
    assert got == cases
    eta = spark.createDataFrame([(0,), (10,), (4000,)], "n long").select(jb.eta_text(F.col("n")).alias("e")).collect()
    assert [r.e for r in eta] == ["Completed", "~0m remaining", "~2h 13m remaining"]
