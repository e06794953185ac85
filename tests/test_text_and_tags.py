from difflib import SequenceMatcher

from pyspark.sql import functions as F

from shelfmark.functions import tags as tg
from shelfmark.functions import text as tx
from shelfmark.operators import albums as al


def test_similarities(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", ""), ("Abbey Road", "abbey road (Remastered)")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", tx.sequence_ratio("a", "b").alias("r"), tx.levenshtein_similarity("a", "b").alias("l"),
                     tx.sequence_ratio_bound("a", "b").alias("u")).collect()
    for r in rows:
        assert r.r == SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio()
        assert r.u >= r.r - 1e-12
    assert [round(r.l, 4) for r in rows][2:4] == [1.0, 0.0]


def test_normalize_name(spark):
    cases = {"The Beatles": "beatles", "Björk": "bjork", "Abbey Road (Deluxe Edition)": "abbey road",
             "OK Computer [Remastered 2017]": "ok computer", "AC/DC": "acdc", "Sigur Rós  ( )": "sigur ros", "": "",
             "Ænima": "ænima", "é": "e"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", tx.normalize_name("t").alias("x")).collect()} == cases


def test_track_fields(spark):
    years = {"2023-01-01": 2023, "abc": None, "12/1999": 1999}
    df = spark.createDataFrame([(k,) for k in years], "t string")
    assert {r.t: r.y for r in df.select("t", tg.extract_year("t").alias("y")).collect()} == years
    numbers = {"1/12": 1, "A1": None, "07": 7}
    df = spark.createDataFrame([(k,) for k in numbers], "t string")
    assert {r.t: r.y for r in df.select("t", tg.extract_track_number("t").alias("y")).collect()} == numbers
    paths = {"/a/1949/x": None, "/a/1950/x": 1950, "/a/x1975": None, "/a (1969) 1971": 1969, "/a/2049": 2049, "/a/2050": None}
    df = spark.createDataFrame([(k,) for k in paths], "t string")
    assert {r.t: r.y for r in df.select("t", tg.path_year("t").alias("y")).collect()} == paths


def test_directory_names(spark):
    cases = {"Pink Floyd - The Wall (1979) [FLAC]": ("Pink Floyd", "The Wall"), "A - B - C": ("A", "B - C"), "Loose": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: (tuple(r.p) if r.p else None) for r in df.select("t", tg.parse_directory("t").alias("p")).collect()}
    assert got == cases


def test_small_tracks(spark):
    rows = [
        ("/m/1.mp3", {"TPE1": ["X"], "TALB": ["Alb"], "TCON": ["Rock"], "TRCK": ["1/12"], "TCMP": ["Yes"]}),
        ("/m/2.flac", {"ARTIST": ["Y"], "ALBUM": ["Alb"], "COMPILATION": ["true"], "GENRE": ["Pop"]}),
        ("/m/3.flac", {"ARTIST": ["Z"], "ALBUM": ["Solo"], "COMPILATION": ["0"], "DATE": ["2023-01-01"]}),
        ("/m/4.flac", {"ARTIST": ["Z"], "ALBUM": [""]}),
        ("/m/5.flac", {"ALBUM": ["No artist"]}),
        ("/m/6.flac", {"TITLE": [], "Title": ["t"], "ARTIST": ["Z"], "ALBUM": ["Solo"], "ALBUMARTIST": ["Z & Co"]}),
    ]
    raw = spark.createDataFrame(rows, "file_path string, tags map<string,array<string>>").withColumn(
        "technical", F.struct(F.lit(0).alias("bitrate"), F.lit(0).alias("sample_rate"), F.lit(2).alias("channels"),
                              F.lit(1.5).alias("duration"), F.lit(9).cast("bigint").alias("file_size")))
    tracks = al.extract_tracks(raw)
    keys = {r.file_path: r.album_key for r in al.valid_tracks(tracks).collect()}
    assert keys == {"/m/1.mp3": "Various Artists|Alb", "/m/2.flac": "Various Artists|Alb", "/m/3.flac": "Z|Solo",
                    "/m/6.flac": "Z & Co|Solo"}
    assert {r.title for r in tracks.where("file_path = '/m/6.flac'").collect()} == {"t"}
    album = {r.album_key: r for r in al.tracks_to_albums(al.valid_tracks(tracks)).collect()}["Various Artists|Alb"]
    assert (album.genres, album.track_count, album.total_duration, album.artist) == (["Pop", "Rock"], 2, 3.0,
                                                                                     "Various Artists")


def test_fingerprint_follows_the_set(spark):
    def one(paths):
        df = spark.createDataFrame([("k", p) for p in paths], "album_key string, file_path string")
        return al.album_paths_hash(df).first().file_hash
    assert one(["a", "b"]) == one(["b", "a"]) != one(["a", "c"])
    assert one(["a"]) != one(["a", "b"])
