from pyspark.sql import functions as F

from shelfmark.functions import genres as gx
from shelfmark.functions import text as tx
from shelfmark.operators import genres as gn
from shelfmark.refdata import Taxonomy

TAX = Taxonomy.default()

# raw, cleaned, strict, default, parents
GOLDEN = [
    ("Hip-Hop", "Hip-Hop", "Hip Hop", "Hip Hop", []),
    ("Rock & Roll", "Rock And Roll", "Rock", "Rock", []),
    ("Electronic", "Electronic", "Electronic", "Electronic", []),
    ("Folk Music", "Folk", "Folk", "Folk", []),
    ("Progressive Rock", "Progressive Rock", "Rock", "Rock", []),
    ("Drum and Bass", "Drum And Bass", "Drum & Bass", "Drum & Bass", ["Electronic"]),
    ("Alt-Country", "Alt-Country", "Country", "Country", []),
    ("Unknown", "Unknown", "Other", "Other", []),
    ("Rock/Blues", "Rock Blues", "Blues", "Rock", []),
    ("Synthpop", "Synthpop", "Synthpop", "Synthpop", ["Electronic", "Pop"]),
    ("R&B", "Randb", "Randb", "R&B", []),
    ("EP", "Ep", "Dubstep", "Dubstep", ["Electronic"]),
    ("!!!", "", "", "", []),
    ("Atmospheric Black Metal", "Atmospheric Black Metal", "Black Metal", "Black Metal", ["Metal"]),
    ("rapcore", "Rapcore", "Rapcore", "Rapcore", []),
    ("Grunge", "Grunge", "Grunge", "Grunge", []),
    ("IDM", "Idm", "IDM", "IDM", ["Electronic"]),
    ("  the  jazz genre ", "Jazz", "Jazz", "Jazz", []),
    ("90s house", "90S House", "House", "House", ["Electronic"]),
]


def test_sizes():
    assert (len(TAX.mappings), len(TAX.lookup), len(TAX.hierarchy), len(TAX.valid)) == (133, 132, 69, 91)


def test_golden(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "raw string")
    rows = df.select("raw", tx.clean_category("raw").alias("c"),
                     gx.normalize_category("raw", TAX, strict=True).alias("s"),
                     gx.normalize_category("raw", TAX).alias("d"),
                     gx.parents_of(gx.normalize_category("raw", TAX), TAX).alias("p")).collect()
    assert [(r.raw, r.c, r.s, r.d, list(r.p)) for r in rows] == GOLDEN


def test_join_form_equals_expression(spark):
    raws = [g[0] for g in GOLDEN] + ["", None, "! !", "dub step", "x"] + [g.lower() for g in TAX.valid]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    for strict in (False, True):
        a = {r.i: r.x for r in df.select("i", gx.normalize_category("raw", TAX, strict).alias("x")).collect()}
        b = {r.i: r.x for r in gn.normalize_values(df, "raw", TAX, "x", strict).collect()}
        assert a == b


def test_title_case(spark):
    texts = ["don't stop", "synth_pop", "épique métal", "90s", "hip-hop", "ABC def", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.title_case("t").alias("x")).collect()
    assert all(r.x == r.t.title() for r in rows)


def test_normalized_list_is_sorted_unique_closed(spark):
    lists = [["Synthpop; IDM", "rock", "ROCK"], ["Black Metal", None, ""], [], None, ["Xyzzy", "xyzzy "]]
    df = spark.createDataFrame([(x,) for x in lists], "l array<string>")
    out = [r.x for r in df.select(gx.normalize_list("l", TAX).alias("x")).collect()]
    assert out == [["Electronic", "IDM", "Pop", "Rock", "Synthpop"], ["Black Metal", "Metal"], [], [], ["Xyzzy"]]
    for names in out:
        assert names == sorted(names) and len({n.lower() for n in names}) == len(names)
        assert all(p in names for n in names for p in TAX.hierarchy.get(n, []))


def test_parse_list(spark):
    cases = [(None, []), ("null", []), ("", []), ('["a","b"]', ["a", "b"]), ("[broken", ["[broken"]),
             ("a; b;;", ["a", "b"]), ("single", ["single"])]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [r.x for r in df.select(gx.parse_list("t").alias("x")).collect()] == [c[1] for c in cases]


def test_list_diff(spark):
    df = spark.createDataFrame([(["Rock", "Pop"], ["rock", "Jazz", "Folk"], ["ROCK", "Jazz"]), ([], [], [])],
                               "o array<string>, s array<string>, f array<string>")
    a, b = [r.d for r in df.select(gx.list_diff("o", "s", "f").alias("d")).collect()]
    assert (a.added, a.removed, a.kept, a.suggested_only, a.has_changes) == (["Jazz"], ["Pop"], ["ROCK"], ["Folk"], True)
    assert (b.added, b.removed, b.kept, b.suggested_only, b.has_changes) == ([], [], [], [], False)


def test_merge_and_suggest(spark):
    df = spark.createDataFrame([(["Rock", "Pop"], ["pop", "Jazz"])], "a array<string>, b array<string>")
    r = df.select(gx.merge_preserving("a", "b").alias("m"), gx.suggest(F.lit("metal"), TAX, 3).alias("s"),
                  gx.merge_for_update(F.array(F.lit("Black Metal")), F.array(F.lit("house")), TAX).alias("u")).first()
    assert r.m == ["Rock", "Pop", "Jazz"]
    assert r.s == ["Black Metal", "Death Metal", "Doom Metal"]
    assert r.u == ["Black Metal", "Metal", "Electronic", "House"]


def test_edits():
    t = TAX.with_mapping("Vapour", "Vaporwave").with_parents("Vaporwave", ["Electronic"])
    assert "Vaporwave" in t.valid and Taxonomy.from_json(t.to_json()) == t
