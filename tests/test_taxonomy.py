"""The join forms of the category operators: any size of taxonomy, whole texts, hierarchies of several levels."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import genres as gx
from shelfmark.operators import genres as gn
from shelfmark.operators import jobs as jb
from shelfmark.refdata import Taxonomy, TaxonomyTables

TAX = Taxonomy.default()
WORDS = ["rock", "Rock & Roll", "R&B", "hip hop", "Hip-Hop", "black metal", "", "  ", "the blues", "Indie Rock Music", "zzz",
         "electro", "house; pop", "Xyzzy", "ROCK", "rock ", "metal", None, "é", "k", "R"]


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(1)
    rows = [(k, rng.choices(WORDS, k=rng.randrange(5))) for k in range(60)] + [(60, None), (61, [None])]
    return spark.createDataFrame(rows, "id long, l array<string>").withColumn("genres", F.col("l"))


def large(extra=100_000):
    """The usual taxonomy and very many names that share no piece of three letters with its texts."""
    tax = TAX
    names = {f"Ж{k}Ж": f"Ж{k}Ж" for k in range(extra)}
    return Taxonomy({**tax.mappings, **names}, tax.hierarchy)


def both_forms(frame, fn, column):
    return [{r.id: r[column] for r in fn(frame, joins).collect()} for joins in (False, True)]


def test_join_forms_equal_literal_forms(lists):
    rows = lists.select("id", "genres")
    literal, joined = both_forms(rows, lambda f, j: gn.normalize_lists(f, "genres", TAX, joins=j), "normalized")
    assert literal == joined and len(literal) == 62 and literal[60] == []
    literal, joined = both_forms(rows, lambda f, j: gn.validate_lists(f, "genres", TAX, joins=j), "checked")
    assert literal == joined
    literal, joined = both_forms(rows, lambda f, j: gn.with_parents(f, "genres", TAX, "p", joins=j), "p")
    assert literal == joined
    literal, joined = both_forms(rows, lambda f, j: gn.with_normalized(f, TAX, joins=j), "n_invalid")
    assert literal == joined
    direct = {r.id: r.m for r in rows.select("id", gx.merge_for_update("genres", F.array(F.lit("house")), TAX).alias("m")).collect()}
    two = rows.withColumn("s", F.array(F.lit("house")))
    literal, joined = both_forms(two, lambda f, j: gn.with_merged(f, "genres", "s", TAX, "m", joins=j), "m")
    assert direct == literal == joined


def test_a_hundred_thousand_entries_give_the_same_lists(spark, lists):
    tax, rows = large(), lists.select("id", "genres")
    small = {r.id: (r.normalized, r.n_valid, r.n_invalid) for r in gn.with_normalized(rows, TAX).collect()}
    got = {r.id: (r.normalized, r.n_valid, r.n_invalid) for r in gn.with_normalized(rows, tax).collect()}
    assert got == small
    counts = [sorted(map(tuple, gn.category_counts(rows.where("genres IS NOT NULL"), t).collect()), key=str) for t in (TAX, tax)]
    assert counts[0] == counts[1]
    results = rows.select("id", F.coalesce("genres", F.array().cast("array<string>")).alias("original_genres"),
                          F.array(F.lit("house")).alias("suggested_genres"), F.lit(99.0).alias("confidence"))
    decided = [{r.id: r.final_genres for r in jb.decide(results, t).collect()} for t in (TAX, tax)]
    assert decided[0] == decided[1]


def test_tables_as_taxonomy(spark, lists):
    tables = TaxonomyTables(TAX.mapping_df(spark), TAX.hierarchy_df(spark))
    rows = lists.select("id", "genres")
    got = {r.id: r.normalized for r in gn.normalize_lists(rows, "genres", tables).collect()}
    assert got == {r.id: r.normalized for r in gn.normalize_lists(rows, "genres", TAX).collect()}


def plain_partial(text, names):
    inside = sorted((-len(n), n) for n in names if n and n.lower() in text)
    around = sorted((len(n), n) for n in names if text in n.lower())
    return (inside or around or [(0, None)])[0][1] if text.strip() else None


def test_containment_equals_trying_every_name(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choices("ab ", k=rng.randint(1, 7))) for _ in range(120)} | {"A", "Bb", "ab" * 40, "é"})
    texts = sorted({"".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(200)} | {"é", "x", "ab" * 30, "a b" * 400})
    valid = spark.createDataFrame([(n,) for n in names], "genre string")
    found = {r.text: r.genre for r in gn.partial_lookup(spark.createDataFrame([(t,) for t in texts], "text string"), valid).collect()}
    assert found == {t: plain_partial(t, names) for t in texts if plain_partial(t, names) is not None}


def test_rows_of_a_text_follow_its_length(spark):
    texts = spark.createDataFrame([("x" * 10 + "abcdefghij" * 500,)], "text string")
    valid = spark.createDataFrame([("name " * 100,), ("abc",), ("jab",)], "genre string")
    assert texts.select(F.explode(gn._grams("text"))).count() <= 3 * 5010
    assert {r.genre for r in gn.contained(texts, valid).collect()} == {"abc", "jab"}


def test_suggestions(spark):
    rows = spark.createDataFrame([(1, "Metal"), (2, ""), (3, None), (4, "no such thing at all"), (5, "k"), (6, "ro"), (1, "Metal")],
                                 "id long, raw string")
    got = {r.id: r.suggestions for r in gn.suggestions(rows, "raw", TAX).collect()}
    want = {r.id: r.s for r in rows.select("id", gx.suggest("raw", TAX).alias("s")).collect()}
    want[3] = []
    assert got == want and gn.suggestions(rows, "raw", TAX).count() == 7


def test_everything_below_and_cycles(spark):
    tax = Taxonomy({}, {"b": ["a"], "c": ["b"], "d": ["c"], "e": ["d", "a"], "x": ["y"], "y": ["x"], "z": ["z", "x"]})
    found = {(r.ancestor, r.descendant): r.depth for r in gn.descendants(spark, tax).collect()}
    assert found == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("a", "e"): 1, ("b", "c"): 1, ("b", "d"): 2, ("b", "e"): 3,
                     ("c", "d"): 1, ("c", "e"): 2, ("d", "e"): 1, ("x", "y"): 1, ("y", "x"): 1, ("x", "z"): 1, ("y", "z"): 2}
    assert gn.descendants(spark, Taxonomy({}, {})).count() == 0


def test_search_finds_grandchildren(spark):
    tax = TAX.with_parents("Mathcore", ["Metalcore"]).with_parents("Metalcore", ["Metal"])
    albums = spark.createDataFrame([("a", ["mathcore"]), ("b", ["Metalcore", "x"]), ("c", ["METAL"]), ("d", ["jazz"]), ("e", [])],
                                   "album_key string, genres array<string>")
    assert {r.album_key for r in gn.albums_with_category(albums, "Metal", tax).collect()} == {"a", "b", "c"}


def test_elements_do_not_carry_their_list(spark):
    """A list of n names went along with each of them: n times the bytes."""
    n, names = 4, 300
    rows = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(names)), lambda i: F.concat(
        F.lit("name "), F.sha1(F.concat_ws("-", i, "id").cast("binary")))).alias("genres")).localCheckpoint()
    tax = TaxonomyTables(rows.select(F.explode("genres").alias("variant"), F.lit("Known").alias("canonical")),
                         spark.createDataFrame([("Known", "Above")], "child string, parent string"))
    for frame, column, want in (
            (gn.normalize_lists(rows, "genres", tax), "normalized", ["Above", "Known"]),
            (gn.validate_lists(rows, "genres", tax).select("id", "checked.valid"), "valid", ["Known"] * names),
            (gn.with_parents(rows.withColumn("genres", F.array_append("genres", F.lit("Known"))), "genres", tax, "o")
             .select("id", F.slice("o", names + 1, 9).alias("o")), "o", ["Known", "Above"])):
        assert [r[column] for r in frame.collect()] == [want] * n
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "_no#" in plan and "Aggregate [_list#" not in plan  # elements meet again by the number of their list
