import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import blocks, dedup, quality


def brute(spark, albums, threshold):
    """All pairs of signatures by comparing everything; for small inputs only."""
    rows = albums.collect()
    seen = {}
    for r in rows:
        k = (r.artist.lower(), r.album.lower(), r.track_count)
        seen[k] = min(seen.get(k, r.album_key), r.album_key)
    pairs = [(ka, kb, *a, *b) for (a, ka), (b, kb) in itertools.combinations(seen.items(), 2)]
    df = spark.createDataFrame(pairs, "k1 string, k2 string, a1 string, t1 string, n1 long, a2 string, t2 string, n2 long")
    sim = tx.album_similarity("a1", "t1", "n1", "a2", "t2", "n2")
    return {tuple(sorted((r.k1, r.k2))) for r in df.where(sim >= threshold).select("k1", "k2").collect()}


def library(spark, seed, n=70):
    rnd = random.Random(seed)

    def mutate(s):
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(s))
            op = rnd.randint(0, 2)
            s = s[:i] + rnd.choice("ab é") + s[i:] if op == 0 else (s[:i] + s[i + 1:] if op == 1 else
                                                                  s[:i] + rnd.choice("xyz") + s[i + 1:])
        return s
    artists = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 12))) for _ in range(6)]
    titles = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 24))) for _ in range(8)]
    rows = [(f"k{i:03d}", mutate(rnd.choice(artists)), mutate(rnd.choice(titles)), rnd.choice([0, 1, 9, 10, 11]))
            for i in range(n)]
    return spark.createDataFrame(rows, "album_key string, artist string, album string, track_count long")


@pytest.mark.parametrize("seed", range(8))
def test_pairs_equal_brute_force(spark, seed):
    albums = library(spark, seed)
    threshold = [0.85, 0.9, 0.8, 0.7, 0.6, 0.75, 0.85, 0.95][seed]
    got = {(r.key1, r.key2) for r in dedup.duplicate_pairs(albums, threshold).collect()}
    assert got == brute(spark, albums, threshold)


def met(spark, rows):
    names = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(rows)], "id long, a string, t string")
    return dedup.candidates(names).count()


def test_shared_beginnings_are_no_key(spark):
    rnd = random.Random(3)

    def names(n):
        return [("customer of " + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=12)),
                 "the album " + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=12))) for _ in range(n)]
    assert met(spark, names(1500)) < 0.02 * 1500 * 1499 / 2


def test_one_title_of_many_artists(spark):
    rnd = random.Random(4)
    rows = [("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=16)), "greatest hits") for _ in range(1500)]
    assert met(spark, rows) < 0.05 * 1500 * 1499 / 2  # random artists share pieces by chance


def test_one_artist_of_many_titles_grows_like_its_titles(spark):
    rnd = random.Random(5)

    def titles(n):
        return ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=rnd.randint(8, 24))) for _ in range(n)]
    for n in (700, 2100):
        others = [(f"{a} and the {t}", t) for a, t in zip(titles(200), titles(200))]
        close = titles(20)
        pairs = [("various artists", t) for t in close] + [("various artist", t[:-1] + "#") for t in close]
        assert met(spark, [("various artists", t) for t in titles(n)] + others + pairs) <= n + 2 * len(pairs)


def test_common_names_with_close_spellings_equal_brute_force(spark):
    """Both ways to compare: pairs of names with few and with many albums."""
    rnd = random.Random(6)
    titles = ["".join(rnd.choices("abc ", k=rnd.randint(0, 14))) for _ in range(60)]
    artists = ["various artists", "various artist", "varius artists", "somebody else", "x"]
    rows = sorted({(rnd.choice(artists), rnd.choice(titles) + rnd.choice(["", "d", "dd"]), rnd.choice([9, 10, 0]))
                   for _ in range(300)})
    albums = spark.createDataFrame([(f"k{i:04d}", *r) for i, r in enumerate(rows)],
                                   "album_key string, artist string, album string, track_count long")
    for threshold in (0.85, 0.7):
        got = [(r.key1, r.key2) for r in dedup.duplicate_pairs(albums, threshold).collect()]
        assert set(got) == brute(spark, albums, threshold) and len(got) == len(set(got))


def test_numbered_series(spark):
    rows = [(f"customer#{i * 37 % 1000:09d}", f"greatest hits {i}") for i in range(1000)]
    albums = spark.createDataFrame([(f"k{i:04d}", a, t, 10) for i, (a, t) in enumerate(rows)],
                                   "album_key string, artist string, album string, track_count long")
    found = dedup.duplicate_pairs(albums).count()
    assert met(spark, rows) <= 10 * (found + len(rows))


def test_copies_stay_linear(spark):
    rows = [(f"k{i:04d}", "Same Artist", "Same Title", 10) for i in range(2000)] + [("z", "same artist", "same titel", 10)]
    albums = spark.createDataFrame(rows, "album_key string, artist string, album string, track_count long")
    assert dedup.duplicate_members(albums).count() == 1999
    pair = dedup.duplicate_pairs(albums).collect()
    assert [(p.key1, p.key2, p.members1, p.members2) for p in pair] == [("k0000", "z", 2000, 1)]


def test_threshold_without_blocking_bound(spark):
    with pytest.raises(ValueError):
        dedup.duplicate_pairs(library(spark, 1), 0.5)


def test_unknown_names_and_counts(spark):
    rows = [("a", "Some Artist", "Some Title", None), ("b", "some artist", "some title", 0), ("c", "Some Artist", "Some Titel", None),
            ("d", None, "Only Title", 3), ("e", None, "Only Titel", 3)]
    albums = spark.createDataFrame(rows, "album_key string, artist string, album string, track_count long")
    assert [(r.album_key, r.canonical_key) for r in dedup.duplicate_members(albums).collect()] == [("b", "a")]
    filled = albums.fillna("").fillna(0)
    found = {(r.key1, r.key2) for r in dedup.duplicate_pairs(albums).collect()}
    assert found == brute(spark, filled, 0.85)


def test_titles_of_common_pieces_are_compared_in_blocks(spark, monkeypatch):
    """Their pieces of three letters are in most of them, so that meeting by pieces made more rows than there are pairs."""
    rnd = random.Random(7)
    titles = ["".join(rnd.choices(["th", "er", "in", "on", "an "], k=14)) for _ in range(60)]
    titles += [t[:9] + "x" + t[10:] for t in titles[:20]]
    rows = [(f"k{i:04d}", rnd.choice(["tionsh.example.net", "tionth.example.net"]), t, 5) for i, t in enumerate(titles)]
    albums = spark.createDataFrame(rows, "album_key string, artist string, album string, track_count long")
    written = {}

    def kept(frame, name, write=dedup.materialize):
        written.setdefault(name, []).append(write(frame, name))
        return written[name][-1]
    monkeypatch.setattr(dedup, "materialize", kept)
    monkeypatch.setattr(dedup, "BLOCK", 16)
    got = [(r.key1, r.key2) for r in dedup.duplicate_pairs(albums).collect()]
    assert set(got) == brute(spark, albums, 0.85) and len(got) == len(set(got)) and len(got) >= 15
    close = written["close"][0]
    assert close.where("common").count() == 0 and close.where("many").count() > 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("longest", [1, 7, 8, 16, 31, 33, 63, 70])
def test_edit_distances_of_many_pairs(longest):
    rnd = random.Random(longest)
    xs, ys = (["ab" * (longest % 2) + "".join(rnd.choices("abé\U0001F600", k=rnd.randint(0, longest))) for _ in range(n)]
              for n in (20, 15))
    x, y = blocks.numbered(xs, ys)
    i, j = (g.ravel() for g in np.indices((20, 15)))
    for p, q, found in zip(i, j, blocks.edits(x, y)(i, j)):
        assert found == distance(xs[p], ys[q]) or (found == 0 and len(xs[p]) > blocks.WORD)


@pytest.mark.parametrize("seed", range(3))
def test_whole_albums_compared_in_blocks_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(dedup, "_blocks_pay", lambda sig, budget: sig.count())
    monkeypatch.setattr(blocks, "BLOCKS", 3)
    albums = library(spark, seed)
    threshold = [0.85, 0.6, 0.75][seed]
    got = [(r.key1, r.key2) for r in dedup.duplicate_pairs(albums, threshold).collect()]
    assert set(got) == brute(spark, albums, threshold) and len(got) == len(set(got))


def test_numbered_series_write_no_pairs_of_close_names(spark, monkeypatch):
    """Close artists and close titles of a series are far more than the albums close in both."""
    rnd = random.Random(8)
    rows = [(f"k{i:04d}", f"customer#{rnd.randrange(900):09d}", f"unplugged collection {i * 37}", 1 + i % 7) for i in range(900)]
    albums = spark.createDataFrame(rows, "album_key string, artist string, album string, track_count long")
    written = []

    def kept(frame, name, write=dedup.materialize):
        written.append(name)
        return write(frame, name)
    monkeypatch.setattr(dedup, "materialize", kept)
    monkeypatch.setattr(dedup, "LEAST_IN_BLOCKS", 500, raising=False)
    got = [(r.key1, r.key2) for r in dedup.duplicate_pairs(albums).collect()]
    assert "close" not in written
    assert set(got) == brute(spark, albums, 0.85) and len(got) == len(set(got))


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_numbered_series_are_put_together_from_parts(monkeypatch, threshold):
    """Every pair of two blocks within the threshold, by tables of the first and last parts of their names."""
    monkeypatch.setattr(blocks, "FEWER", 1)
    monkeypatch.setattr(blocks, "SLICE", 100)
    monkeypatch.setattr(blocks, "RARE", 30)
    rnd = random.Random(5)

    def side(n):
        return ([rnd.choice(["", "dj "]) + f"customer#{rnd.randrange(90):04d}" for _ in range(n)],
                [f"studio {rnd.randrange(1, 2000)}" for _ in range(n)], np.array([rnd.choice([0, 1, 2, 7]) for _ in range(n)]))
    (a1, t1, n1), (a2, t2, n2) = side(300), side(250)
    (xa, ya), (xt, yt) = blocks.numbered(a1, a2), blocks.numbered(t1, t2)
    found = blocks.met_in_parts((xa, ya), (xt, yt), n1, n2, threshold)
    assert found is not None
    met = [(int(p), int(q)) for i, j, _ in found for p, q in zip(i, j)]
    assert len(met) == len(set(met)) < 300 * 250 * (0.5 if threshold == 0.85 else 0.8)
    apart_a, apart_t = (blocks.edits(x, y) for x, y in ((xa, ya), (xt, yt)))
    i, j = (g.ravel() for g in np.indices((300, 250)))
    alike = (0.4 * (1 - apart_a(i, j) / np.maximum(xa.size[i], ya.size[j])) + 0.1 * blocks.count_similarity(n1[i], n2[j])
             + 0.5 * (1 - apart_t(i, j) / np.maximum(xt.size[i], yt.size[j])))
    near = alike >= threshold
    assert near.sum() > 20 and set(zip(i[near].tolist(), j[near].tolist())) <= set(met)


def test_few_artists_of_many_titles_are_compared_in_blocks(spark, monkeypatch):
    """Each artist's titles were compared pair by pair in a join, and those of every close artist's with them."""
    rnd = random.Random(9)
    titles = ["".join(rnd.choices(["th", "er", "in", "on", "an "], k=14)) for _ in range(560)]
    titles += [t[:9] + "x" + t[10:] for t in titles[:40]]
    hosts = ["tionsh.example.net", "tionth.example.net", "blog.ththre.example.org"]
    rows = [(f"k{i:04d}", rnd.choice(hosts), t, rnd.choice([0, 5, 6])) for i, t in enumerate(titles)]
    albums = spark.createDataFrame(rows, "album_key string, artist string, album string, track_count long")
    written = []

    def kept(frame, name, write=dedup.materialize):
        written.append(name)
        return write(frame, name)
    monkeypatch.setattr(dedup, "materialize", kept)
    monkeypatch.setattr(dedup, "LEAST_IN_BLOCKS", 500)
    monkeypatch.setattr(blocks, "MANY_ROWS", 8)
    got = [(r.key1, r.key2) for r in dedup.duplicate_pairs(albums).collect()]
    assert "close" not in written
    assert set(got) == brute(spark, albums, 0.85) and len(got) == len(set(got)) and len(got) >= 15


def test_rows_go_to_the_blocks_that_may_hold_a_partner(spark):
    rows = [(f"some artist {i}", ["unplugged collection", "greatest hits"][i % 2] + f" {i}", 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "a string, t string, n long")
    held = frame.repartitionByRange(8, "t").withColumn("block", F.spark_partition_id()).cache()
    kind = F.substring("t", 1, 3)
    at = {(r.block, r.kind) for r in held.select("block", kind.alias("kind")).distinct().collect()}
    dealt = blocks.units(held, 8, 0.85)
    assert dealt.where("u = v").count() == 400
    assert dealt.where("block NOT IN (u, v)").isEmpty()
    for r in dealt.select(kind.alias("kind"), F.when(F.col("block") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("other")
                          ).distinct().collect():
        assert (r.other, r.kind) in at


def test_issues_name_both_albums_with_and_without_repeated_keys(spark):
    rows = [("a", "Some Artist", "Some Title", 3), ("b", "some artist", "some titel", 3), (None, "Some Artist", "Some Titlee", 3)]
    schema = "album_key string, artist string, album string, track_count long"

    def found(rows):
        return sorted((r.album_key, r.artist, r.description.split(" (")[0]) for r in
                      quality.duplicate_issues(spark.createDataFrame(rows, schema)).collect())
    pair = ("a", "Some Artist", 'Potential duplicate: "some artist - some titel"')
    itself = [("a", "Some Artist", 'Potential duplicate: "Some Artist - Some Title"'),
              ("b", "some artist", 'Potential duplicate: "some artist - some titel"')]
    assert found(rows) == sorted([pair, *itself])
    assert found([*rows, ("b", "Other", "Unlike all", 9)]) == sorted(
        [pair, ("a", "Some Artist", 'Potential duplicate: "Other - Unlike all"'), itself[0], itself[1],
         ("b", "some artist", 'Potential duplicate: "Other - Unlike all"'), ("b", "Other", itself[1][2]),
         ("b", "Other", 'Potential duplicate: "Other - Unlike all"')])
