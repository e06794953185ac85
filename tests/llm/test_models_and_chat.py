"""Classifiers on held-out labels, URL filters, quotation linking, and the pipeline against plain steps."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import pii_crf, quality_pu, quote_chat, toxicity_ftrl, url_filter
from shelfmark.llm.common import prepare
from shelfmark.llm.spans import replaced
from tests.llm import brute

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


def check_classifier(spark, score, column):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == brute.held_out(i) for i, r in rows.items())
    marks = [(rows[r.doc_id], r[column]) for r in labels.collect() if r[column] is not None and brute.held_out(r.doc_id)]
    area = brute.auc([r.score for r, _ in marks], [m for _, m in marks])
    right = sum(r.predicted == m for r, m in marks) / len(marks)
    return area, right


def test_quality_on_held_out_labels(spark):
    area, right = check_classifier(spark, quality_pu.score, "quality")
    assert area > 0.98 and right > 0.97


def test_toxicity_on_held_out_labels(spark):
    area, right = check_classifier(spark, toxicity_ftrl.score, "toxic")
    assert area > 0.95 and right > 0.93


def test_quality_from_positives_only(spark):
    """Without a single negative label: the same scores, and as good ones."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    first, second = (quality_pu.score(docs, x).orderBy("doc_id").collect() for x in (labels, labels.where("quality = 1")))
    assert first == second
    rows = {r.doc_id: r for r in second}
    marks = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if r.quality is not None and brute.held_out(r.doc_id)]
    assert brute.auc(*zip(*marks)) >= 0.97


def test_quality_when_every_document_is_labelled(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = {r.doc_id: r.score for r in quality_pu.score(docs, labels).collect()}
    marks = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in rows and brute.held_out(r.doc_id)]
    assert len(set(rows.values())) > 100 and brute.auc(*zip(*marks)) >= 0.97


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(4)

    def drawn(n, good):
        return rng.normal(np.where(np.arange(n)[:, None] < good * n, 1.5, -1.5), 1.0, (n, quality_pu.MEASURES))
    for share in (0.3, 0.6, 0.9):
        assert abs(quality_pu.class_prior(rng.permutation(drawn(2000, 1)), rng.permutation(drawn(4000, share))) - share) < 0.06
    assert quality_pu.class_prior(drawn(2, 1), drawn(50, 0.5)) == 0.5


def test_scale_minimises_the_unbiased_risk():
    rng = np.random.default_rng(5)
    positive, unlabelled = (rng.normal(m, 1, (n, quality_pu.MEASURES)) for m, n in ((0.2, 300), (0, 500)))
    model = quality_pu.fit(positive, unlabelled, 0.5)
    scaled = quality_pu.calibrate(model, positive, unlabelled, 0.5, ridge=0.05)
    fp, fu = (model.weights[model.bins(x)].sum(axis=1) + model.bias for x in (positive, unlabelled))
    slope = scaled.weights[0] / model.weights[0]
    shift = scaled.bias - slope * model.bias

    def risk(a, b):
        """The risk as it is defined, one text after the other."""
        of_positive = [0.5 * math.log1p(math.exp(-(a * f + b))) - 0.5 * math.log1p(math.exp(a * f + b)) for f in fp]
        of_unlabelled = [math.log1p(math.exp(a * f + b)) for f in fu]
        return (sum(of_positive) / len(fp) + sum(of_unlabelled) / len(fu)
                + 0.05 / 2 * ((a - 1) ** 2 + b ** 2))
    for a, b in ((1.05, 0), (0.95, 0), (1, 0.05), (1, -0.05)):
        assert risk(slope, shift) < risk(slope * a, shift + b)


@pytest.mark.parametrize("module", [quality_pu, toxicity_ftrl])
def test_odd_rows(spark, module):
    texts = [None, "", "a b c", "a b c", "you loser", brute.prose(20_000), "###"]
    ids = [1, 2, 3, 3, None, 6, 7]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 0, 0), (None, 1, 1), (99, 1, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    docs = brute.frame(spark, texts, ids)
    rows = module.score(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert module.score(docs, labels.limit(0)).count() == len(ids)
    assert module.score(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(600), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 0)
                              .otherwise(F.col("quality")))
    first, second = (quality_pu.score(docs, x).orderBy("doc_id").collect() for x in (labels, other))
    assert first == second


URLS = [("http://a.NET/x?q#f", "a.net", "/x", "net/", "block"), ("https://example.net/en/1", "example.net", "/en/1",
        "example.net/en/", "allow"), ("ftp://m.example.net/en", "m.example.net", "/en", "net/", "block"),
        ("http://xexample.com/de/", "xexample.com", "/de/", None, None), ("http://b.example.com/de/?a", "b.example.com",
        "/de/", "example.com/de/", "block"), ("http://x.org/fr/a://b", "x.org", "/fr/a://b", "org/fr/", "allow"),
        ("http://net", "net", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
        ("http://?x", "", "", None, None), ("http://É.NET#/x", "É.net", "", None, None), ("", "", "", None, None)]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(URLS * 3)], "page_id long, url string, score string")
    rows = url_filter.judge(pages).orderBy("page_id").collect()
    for r, u in zip(rows, URLS * 3):
        assert (r.host, r.path, r.rule) == u[1:4] and r.verdict == (u[4] or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_models_tell_the_kinds_apart(spark):
    good = [f"http://news{k}.org/fr/article-{k}" for k in range(150)]
    bad = [f"http://casino{k}.net/win?x={k}" for k in range(150)]
    new = [("http://casino999.info/win", "block"), ("http://news999.info/fr/article-7", "allow")]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*good, *bad, *(u for u, _ in new)])], "page_id long, url string")
    rows = url_filter.judge(pages).where("rule IS NULL").orderBy("page_id").collect()
    assert [r.verdict for r in rows] == [v for _, v in new]


def plain_score(text, good, bad):
    """Both chains over all counts, one character at a time."""
    def log(examples):
        follow = [Counter() for _ in range(6)]
        for example in examples:
            raw = b"\x02" * 5 + example.encode() + b"\x03"
            for i in range(5, len(raw)):
                for k in range(6):
                    follow[k][raw[i - k:i], raw[i]] += 1
        raw, total = b"\x02" * 5 + text.encode() + b"\x03", 0.0
        for i in range(5, len(raw)):
            p = 1 / 256
            for k in range(6):
                own = {c: n for (context, c), n in follow[k].items() if context == raw[i - k:i]}
                if own:
                    p = (own.get(raw[i], 0) + len(own) * p) / (sum(own.values()) + len(own))
            total += math.log(p)
        return total
    return (log(good) - log(bad)) / (len(text.encode()) + 1)


def test_url_scores_are_exact(spark):
    good, bad, new = ["a.org/fr/x-é", "a.org/fr/x-é", "b.org/fr/yy"], ["c.net/win", "c.net/%ff"], ["a.net/fr/x", "q", ""]
    examples = spark.createDataFrame([("allow", t) for t in good] + [("block", t) for t in bad], "verdict string, text string")
    rows = url_filter.scores(spark.createDataFrame([(t,) for t in new + good + new], "text string"), examples).collect()
    found = {r.scored: r.score for r in rows}
    assert len(rows) == len(found) == 5 and found[""] == 0
    assert all(abs(s - plain_score(t, good, bad)) < 1e-9 for t, s in found.items() if t)


def test_url_tables_grow_with_the_input(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-/", k=60)) for _ in range(2500)]
    pairs, contexts = url_filter.train(spark.createDataFrame([("allow", t) for t in texts], "verdict string, text string"))
    assert pairs.count() > 1 << 18 and contexts.agg(F.max("n_allow")).first()[0] == 2500 * 61


def test_quote_links(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> hello   THERE\nFine."),
            (1, 2, "user", ">> Hello there\n> Fine.\nGood!"), (1, 3, "user", "> Good!\n\n> Fine.\nSee you"),
            (1, 4, "user", ">not known\nAlone"), (1, 5, "user", "> Alone"), (1, 5, "user", "twice"),
            (2, 0, "user", "> Fine."), (2, 1, None, None), (None, 3, "user", "> Fine."), (3, None, "user", "x"),
            (4, 0, "user", "same"), (4, 1, "user", "same\n> same"), (4, 2, "user", "> same\nmore")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))
    found = {(r.conv_id, r.turn, r.text): r for r in quote_chat.format_chat(frame).collect()}
    get = lambda c, t, x: (found[c, t, x].reply_to, found[c, t, x].thread, found[c, t, x].depth)
    assert get(1, 0, "Hello there\nHow are you?") == (None, 0, 0) and get(1, 1, "Fine.") == (0, 0, 1)
    assert get(1, 2, "Good!") == (1, 0, 2) and get(1, 3, "See you") == (2, 0, 3)
    assert get(1, 4, "Alone") == (None, 4, 0) and get(1, 5, "") == (4, 4, 1) and get(1, 5, "twice") == (4, 4, 1)
    assert get(2, 0, "") == (None, 0, 0) and get(2, 1, "") == (None, 1, 0) and get(None, 3, "") == (None, 3, 0)
    assert get(4, 1, "same") == (0, 0, 1) and get(4, 2, "more") == (1, 0, 2)
    assert len(found) == len(rows) and quote_chat.format_chat(frame.limit(0)).count() == 0


def plain_links(rows):
    """(conv, turn) to (reply_to, linked passages), by comparing every passage with every earlier turn."""
    wrote, asked = {}, {}
    for conv, turn, text in rows:
        runs = []
        for line in (text or "").split("\n"):
            marker = re.match(r"(?:[ \t]*>)*", line)[0]
            words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", line[len(marker):].lower()) if w]
            level = marker.count(">")
            if level == 0 and len(words) < 5:
                wrote.setdefault((conv, turn), set()).add(tuple(words))
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].extend(words)
        for level, words in runs:
            grams = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
            if words and level == 0:
                wrote.setdefault((conv, turn), set()).update(grams)
            elif words:
                asked.setdefault((conv, turn), {})[level, tuple(words)] = grams
    found = {}
    for (conv, turn), quoted in asked.items():
        sums = {}
        for (level, _), grams in quoted.items():
            earlier = sorted(t for c, t in wrote if c == conv and t < turn)
            points = [max(have) for g in grams if (have := [t for t in earlier if g in wrote[conv, t]])]
            if points:
                origin = max(points, key=lambda t: (points.count(t), t))
                n = len(grams & wrote[conv, origin])
                if n * 5 >= len(grams) * 4:
                    old = sums.get((level, origin), (0, 0))
                    sums[level, origin] = (old[0] + n, old[1] + 1)
        if sums:
            (_, origin), _ = max(sums.items(), key=lambda x: (-x[0][0], x[1][0], x[0][1]))
            found[conv, turn] = (origin, sum(n for _, n in sums.values()))
    return found


def test_quote_links_match_plain_comparison(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "Thanks,", "Ärger", "so"]
    rows = []
    for conv in range(6):
        for turn in range(25):
            lines = []
            for _ in range(rng.randrange(6)):
                if rows and rows[-1][0] == conv and rng.random() < 0.6:
                    said = rng.choice([r[2] for r in rows if r[0] == conv]).split("\n")
                    part = rng.choice([x for x in said if ">" not in x] or [""]).split()[rng.randrange(2):]
                    mark = rng.choice(["> ", ">> ", " > > "])
                    lines += [mark + " ".join(part[k:k + 3]) for k in range(0, len(part), 3)]
                else:
                    lines.append(" ".join(rng.choices(words, k=rng.randrange(12))))
            rows.append((conv, turn, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    expected = plain_links(rows)
    assert len(expected) > 30
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in quote_chat.links(frame).collect()} == expected


def test_shingles_stay_with_their_conversation_unless_it_is_large(spark, monkeypatch):
    """Only the shingles of large conversations are shuffled; both ways give the same links and the same replies."""
    texts = ["one two three four five six seven", "eight nine ten eleven twelve one two three four five", "Thanks", "a b c d e f g h"]
    rows = [(c, t, "user", texts[(c + t) % 4] + f"\nmore of {t % 3} and so on and on") for c in (1, 2, 3) for t in range(9)]
    rows += [(1, 4, "user", texts[0]), (None, 1, "user", texts[1]), (2, None, "user", texts[2]), (3, 2, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def outcome():
        replies = quote_chat.quoting(frame).cache()
        linked = quote_chat.links(replies.select("conv_id", "turn", "text"))
        plan = linked._jdf.queryExecution().executedPlan().toString()
        moved = any("hashpartitioning" in line and "gram" in line for line in plan.splitlines())
        return moved, sorted(map(str, replies.collect())), sorted(map(str, quote_chat.format_chat(replies).collect()))
    moved, *small = outcome()
    assert not moved
    for messages in (0, 9):  # all conversations, the one with a repeated turn
        monkeypatch.setattr(quote_chat, "MESSAGES", messages)
        moved, *found = outcome()
        assert moved and found == small


def test_wrapped_edited_and_common_quotes(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, 0, "one two three four five six seven eight\nThanks,"), (1, 1, "Thanks,\nother words"),
            (1, 2, "> one two three\n> four five six\n> seven eight\nwrapped"), (1, 3, "> Thanks,\nlast writer"),
            (1, 4, "> " + " ".join(f"x{k}" for k in range(30))), (2, 0, long),
            (2, 1, "\n".join("> " + " ".join(long.split()[k:k + 7]) for k in range(0, 60_000, 7))),
            (2, 2, "> " + " ".join(w for k, w in enumerate(long.split()) if k % 40) + "\nedited"),
            (2, 3, "> " + " ".join(w for k, w in enumerate(long.split()) if k % 6) + "\nanother text")]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): r.reply_to for r in quote_chat.format_chat(frame).collect()}
    assert found == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): None,
                     (2, 0): None, (2, 1): 0, (2, 2): 0, (2, 3): None}


def test_a_line_that_thousands_wrote_and_quoted(spark):
    frame = spark.range(5000).selectExpr(
        "1L AS conv_id", "id * 700 AS turn", "'user' AS role",
        "CASE WHEN id % 2500 = 0 THEN 'me too' WHEN id % 3 = 0 THEN '> me too' ELSE 'else' END AS text")
    found = {r.turn // 700: r.reply_to for r in quote_chat.links(frame).collect()}
    assert found == {k: k // 2500 * 1_750_000 for k in range(5000) if k % 3 == 0 and k % 2500}


def test_long_chain_of_replies(spark):
    rows = [(1, k, "user", f"> line {k - 1}\nline {k}") for k in range(100)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quote_chat.format_chat(frame).orderBy("turn").collect()
    assert [r.depth for r in found] == list(range(100)) and all(r.thread == 0 for r in found)


def test_pipeline_against_plain_steps(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    from shelfmark.llm import quality_rules
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert all(not brute.quality(texts[i])[5] for i in kept)
    nodes = [(i, brute.simhash(texts[i])) for i in sorted(kept)]
    first = set(brute.components(nodes, lambda a, b: (a ^ b).bit_count() <= 2))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [i for i, c in zip(sorted(first), brute.contamination([texts[i] for i in sorted(first)], items)) if not c[4]]
    field = pii_crf.train()
    final = {i: replaced(texts[i], pii_crf._all_spans(field, [texts[i]])[0][1]) for i in clean}
    from shelfmark.llm import packing
    encode = packing.Encoder(packing.VOCABULARY)
    lengths = {i: len(encode(t.encode())) // 4 + 1 for i, t in final.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    found = {}
    for r in rows:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == lengths
