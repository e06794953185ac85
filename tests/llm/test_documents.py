"""Operators on documents against plain Python, with nulls, empty and long texts, repeats and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, quality_rules, simhash_dedup
from shelfmark.llm.common import prepare
from shelfmark.llm.graph import components
from tests.llm import brute


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


BASE = brute.prose(200, 1)
ODD = [None, "", "  \n\t ", "one", "Two Words", BASE, BASE, BASE.upper(), BASE.replace("w1", "v1", 1), BASE + " extra",
       "a\n\na\nb b b b b b b b b b b b\n a\n" * 3, "é ñ ß # $ % ü " * 5, brute.prose(20_000, 2), "the of and " * 400,
       "x\u00a0y\u2003z\u0085q the cat", BASE + "\n" + BASE]
IDS = [7, 3, 3, None, 12, 40, 9, 8, 31, 30, 29, 28, 27, 26, None, 25]


def test_simhash(spark):
    rows = simhash_dedup.near_duplicates(brute.frame(spark, ODD, IDS)).collect()
    prints = [brute.simhash(t) for t in ODD]
    roots = brute.components(list(zip(IDS, prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    expected = sorted(map(str, zip(IDS, (f"{p:016x}" for p in prints), roots)))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in rows) == expected
    assert simhash_dedup.near_duplicates(brute.frame(spark, [])).count() == 0


def test_links_find_every_close_pair(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    values = set(seeds)
    for s in seeds:
        for _ in range(40):
            for _ in range(rng.randrange(1, 4)):
                s ^= 1 << rng.randrange(64)
            values.add(s)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    expected = brute.components([(s, v) for s, v in zip(signed, values)], lambda a, b: (a ^ b).bit_count() <= 2)
    close = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for limit in (1, 8, 1000):  # every block split, some, none
        found = [tuple(r) for r in simhash_dedup.links(nodes, limit).collect()]
        assert len(set(found)) == len(found) and set(found) <= close
        assert limit < 1000 or set(found) == close
        roots = {r.node: r.root for r in components(simhash_dedup.links(nodes, limit)).collect()}
        assert [roots.get(s, s) for s in signed] == expected


def test_links_stay_linear_in_a_dense_group(spark):
    # All values within 12 bits: every one has many partners, but costs a bounded number of rows.
    nodes = spark.range(4096).select(F.col("id").alias("fp"))
    found = simhash_dedup.links(nodes)
    assert found.count() <= 65 * 4096
    assert components(found).agg(F.max("root")).first()[0] == 0


def test_chain_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(edges)
    assert found.count() == 301 and found.where("root <> 0").count() == 0
    assert components(edges.where("a < 0")).count() == 0


def test_keep_firsts(spark):
    kept = simhash_dedup.keep_firsts(brute.frame(spark, ODD, IDS))
    assert kept.columns == brute.DOCS.names
    ids = [r.doc_id for r in kept.collect()]
    rooted = brute.components([(i, brute.simhash(t)) for i, t in zip(IDS, ODD) if i is not None],
                              lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(i for i in ids if i is not None) == sorted(set(rooted))
    assert ids.count(None) == 2


def test_filters_judge_rows_not_ids(spark):
    other = brute.prose(200, 9)
    docs = brute.frame(spark, [BASE, BASE, other, brute.prose(200, 8), other, BASE], [None, None, 5, 5, 5, None])
    kept = simhash_dedup.keep_firsts(docs)
    assert kept.schema == docs.schema
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(
        map(str, [(None, BASE), (5, other), (5, brute.prose(200, 8))]))
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[20:60])), (2, other)], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.schema == docs.schema and [(r.doc_id, r.text) for r in clean.collect()] == [(5, brute.prose(200, 8))]


ITEMS = [(1, " ".join(BASE.split()[20:60])), (2, " ".join(BASE.split()[40:55]).upper()), (3, "w1 w2 w3"), (4, "one"),
         (5, None), (6, ""), (None, "Two Words"), (7, "short only here"), (8, " ".join(BASE.split()[100:112])),
         (9, "one")]


def test_contamination(spark):
    texts = ODD + ["zz w1 w2 w3 w1 w2 w3", "w1 w2", "short only here short only here"]
    ids = IDS + [100, 101, 102]
    docs = brute.frame(spark, texts, ids)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_words", F.lit("x"))
    rows = decontaminate.contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    expected = brute.contamination(texts, ITEMS)
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, *e)) for i, e in zip(ids, expected))
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == brute.DOCS.names
    bad = {i for i, e in zip(ids, expected) if e[-1] and i is not None}
    assert {r.doc_id for r in kept.collect()} == set(ids) - bad


def test_contamination_empty_tables(spark):
    docs = brute.frame(spark, ODD, IDS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_items_without_id_hit(spark):
    shared = " ".join(f"shared{k}" for k in range(30))
    bench = spark.createDataFrame([(None, shared), (None, "other words"), (7, None)], "item_id long, text string")
    rows = decontaminate.contamination(brute.frame(spark, [shared, "clean text", None]), bench).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in rows] == [
        (30, 0, [], True), (0, 0, [], False), (0, 0, [], False)]


def test_every_shared_span_is_found(spark):
    rng = random.Random(3)
    words = [f"t{rng.randrange(6)}" for _ in range(400)]  # few words, so that runs repeat
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(60)]
    texts = [" ".join(rng.choices(words, k=40) + items[rng.randrange(60)][1].split()[:rng.randrange(1, 20)])
             for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(brute.frame(spark, texts), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in rows] == [e[:3] for e in brute.contamination(texts, items)]


def test_quality_rules(spark):
    rows = quality_rules.judge(brute.frame(spark, ODD, IDS)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert (sorted(str((r.doc_id, *[r[n] for n in names])) for r in rows)
            == sorted(str((i, *brute.quality(t))) for i, t in zip(IDS, ODD)))
    assert all(not (r.kept and r.base_failed) for r in rows)
    assert quality_rules.judge(brute.frame(spark, [])).count() == 0


def test_keep_good(spark):
    clean = ["The cat and the dog of the house went to " + brute.prose(40, k) + " and it is in the garden." for k in range(5)]
    junk = [None, "", "%%% ### " * 40, "word " * 100, "short text", "| a | b " * 30]
    docs = brute.frame(spark, clean + junk)
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == list(range(5))


def test_quality_plan_is_native(spark):
    plan = quality_rules.judge(brute.frame(spark, ODD, IDS))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange", "Pandas"))
