"""Language network, divergence of sources and centroids against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import centroids, divergence, language_gru
from shelfmark.llm.common import prepare
from tests.llm import brute

SF = "/root/testdata/sf0.1"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


# ---- language

def test_gradients_equal_differences():
    net, rng = language_gru.Network(3, 4, kind=np.float64), np.random.default_rng(1)
    windows = rng.integers(0, 256, (3, 7)).astype(np.uint8)
    valid = (np.arange(7) < np.array([7, 5, 2])[:, None]).astype(float)
    marks = np.array([0, 2, 1])
    _, grads = net.gradients(windows, valid, marks, valid)
    for name, w in net.weights.items():
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in w.shape)
            if name == "x":
                at = (at[0], at[1], int(windows[0, rng.integers(0, 7)]))
            old, losses = w[at], []
            for step in (1e-6, -1e-6):
                w[at] = old + step
                losses.append(net.gradients(windows, valid, marks, valid)[0])
            w[at] = old
            assert abs((losses[0] - losses[1]) / 2e-6 - grads[name][at]) < 1e-7


def plain_probabilities(net, raw):
    """One byte after the other, with lists."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    h = w["u"].shape[2]

    def read(side, order):
        state, out = np.zeros(h), {}
        for at in order:
            x, r = w["x"][side][:, raw[at]], w["u"][side] @ state
            b = w["b"][side][:, 0]
            z, reset = (np.clip(language_gru.SLOPE * (x[k:k + h] + r[k:k + h] + b[k:k + h]) + 0.5, 0, 1) for k in (0, h))
            new = np.tanh(x[2 * h:] + reset * (r[2 * h:] + b[2 * h:]))
            state = (1 - z) * new + z * state
            out[at] = state
        return out
    left, right = read(0, range(len(raw))), read(1, reversed(range(len(raw))))
    rows = [w["o"][0] @ left[k] + w["o"][1] @ right[k] + w["c"][:, 0] for k in range(len(raw))]
    return [np.exp(r) / np.exp(r).sum() for r in rows]


def test_positions_and_pooling_equal_one_byte_at_a_time():
    net = language_gru.Network(3)
    net.weights["b"] += 0.1
    texts = ["Grüße an alle, 1, 2!", "x", "The quick brown fox jumps over the lazy dog and then it goes home again, slowly. " * 3]
    got = language_gru.pooled(net, [t.encode() for t in texts], 3)
    for text, found in zip(texts, got):
        raw, total, n = text.encode(), np.zeros(3), 0
        for at in range(0, len(raw), language_gru.WINDOW):
            piece = raw[at:at + language_gru.WINDOW]
            for byte, p in zip(piece, plain_probabilities(net, piece)):
                if chr(byte).isascii() and not chr(byte).isalpha():
                    continue
                total, n = total + p, n + 1
        assert np.abs(total / n - found).max() < 1e-4


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in language_gru.predict(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == brute.held_out(i) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) / len(held) > 0.99


def test_language_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(language_gru, "STEPS", 40)
    texts = ["hello world and more words " * 3, "der hund und die katze " * 4, None, "", "12 + 3 = 15 !", "あいう" * 30, "é",
             "the end of the story " * 9000, "hello world and more words " * 3]
    ids = [1, 2, 4, 5, 7, None, 8, 9, 9]
    docs = brute.frame(spark, texts, ids).withColumn("lang", F.when(F.col("text").startswith("der"), "de").when(
        F.col("text").startswith("hello"), "en")).withColumn("lang_pred", F.lit("x"))
    rows = language_gru.predict(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
    found = {(r.doc_id, r.score > 0): r.lang_pred for r in rows}
    assert all(found[i, False] == "und" for i in (4, 5, 7)) and found[2, True] == "de"
    assert all(r.lang_pred in ("de", "en") for r in rows if r.score > 0) and sum(r.score > 0 for r in rows) == 6
    assert all(r.lang_pred == "und" for r in language_gru.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language_gru.predict(docs.limit(0)).count() == 0


def test_held_out_languages_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(language_gru, "STEPS", 10)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "zz")
                            .otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    first, second = (language_gru.predict(d).orderBy("doc_id").collect() for d in (docs, other))
    assert first == second


# ---- divergence

def plain_divergence(rows, least_docs, top):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = {}, {}
    for lang, source, text in rows:
        words = [w.translate(brute.LOWER) for w in TERM.findall(text)]
        counts.setdefault((lang, source), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang in docs:
        kept = [w for w, n in docs[lang].items() if n >= least_docs]
        groups = {s: c for (own, s), c in counts.items() if own == lang}

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10 ** 9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}
        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))

        def gap(a, b):
            return (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(gap(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in groups if o != s]
            own = [(-gap(p[s][w], q[w]), w.encode(), w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", own, top)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "Bee", "straße", "eightish", "sixteenlettersxx", "seventeenletterss", "É", "日本語日本語", "y" * 33, "z" * 700,
             "Z" * 700, "eightisha", "eightishb", "x" * 15, "x" * 16, "zzzzzzzz", "ÿÿ"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(n):
        text = rng.choice([" ", "-", "\n", "9", "\u0001"]).join(rng.choices(words, k=rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "fr", "", None]), rng.choice(["s1", "s1", "s2", "S3", "", None]),
                     rng.choice([text, text, text, None, "", "123"])))
    return rows


def found_rows(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int")
    return sorted(tuple(r) for r in divergence.diverging(frame, **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_divergence_equals_plain_counting(spark, seed):
    rows = corpus(seed)
    assert found_rows(spark, rows) == plain_divergence(rows, 10, 10)


def test_divergence_of_few_rows(spark):
    rows = [("en", "a", "x"), ("en", "b", None), ("en", "b", "x y x"), (None, None, None), ("en", "c", "")]
    for least in (1, 2, 10):
        assert found_rows(spark, rows, least_docs=least) == plain_divergence(rows, least, 10)
    assert found_rows(spark, []) == []


def test_divergence_in_small_pieces(spark, monkeypatch):
    """Long texts that are cut, counts sent early, and more than one tile of sources; run in this process."""
    rng = random.Random(5)
    rows = [("en", f"s{rng.randrange(9)}", " ".join(rng.choices(["aa", "b" * 20, "é", "word", "longerword" * 5], k=rng.randrange(900))))
            for _ in range(60)]
    monkeypatch.setattr(divergence, "CHUNK", 256)
    monkeypatch.setattr(divergence, "HELD", 20)
    import pyarrow as pa
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k:k + 7])], names=["lang", "source", "text"])
               for k in range(0, len(rows), 7)]
    n, docs = Counter(), Counter()
    for batch in divergence._scan(iter(batches)):
        for r in batch.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    plain_n, plain_docs = Counter(), Counter()
    for _, source, text in rows:
        plain_n.update((source, w) for w in TERM.findall(text))
        plain_docs.update({(source, w) for w in TERM.findall(text)})
    assert n == plain_n and docs == plain_docs
    monkeypatch.setattr(divergence, "TILE", 4)
    least = np.array([rng.randrange(1, 50) for _ in range(10)])
    terms = [(np.array(sorted(rng.sample(range(10), k))), np.array([rng.randrange(60, 10 ** 9) for _ in range(k)]))
             for k in (1, 3, 10, 2, 7)]
    for i, j, total in divergence.pair_sums(terms, least):
        for (x, y), value in np.ndenumerate(total):
            shares = [[dict(zip(at, p)).get(k, least[k]) for at, p in terms] for k in (i + x, j + y)]
            assert value == sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(*shares))


def test_radix_order_is_stable():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (500, 2)).astype(np.uint64) << np.uint64(40)
    order = divergence.radix_order(words)
    assert order.tolist() == sorted(range(500), key=lambda k: (words[k].tolist(), k))


# ---- centroids

def plain_clusters(rows, clusters=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by comparing all components."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64
            and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    each = Counter()
    for d, k in last:
        each[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, each[k], sum(each.values()), digest[k]) for (i, _), (d, k) in zip(kept, last)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 "vec_id long, embedding array<double>, cluster string, v int")


@pytest.mark.parametrize("seed,n,spread", [(1, 150, 3.0), (2, 40, 0.05), (3, 9, 1.0), (4, 60, 3e5)])
def test_clusters_equal_comparing_everything(spark, seed, n, spread):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, spread) for _ in range(64)]) for k in range(n)]
    rows += rows[:5] + [(None, rows[0][1]), (n, None), (n + 1, [0.5] * 63), (n + 2, [float("nan")] * 64), (n + 3, []),
                        (n + 4, [None] + [0.1] * 63), (n + 5, [float("-inf")] + [0.1] * 63)]
    got = sorted((tuple(r) for r in centroids.inertia(vectors(spark, rows)).collect()), key=repr)
    assert got == plain_clusters(rows)


def test_equal_vectors_and_no_vectors(spark):
    rows = [(k, [0.25] * 64) for k in range(40)]
    got = centroids.inertia(vectors(spark, rows)).collect()
    assert {r.cluster for r in got} == {0} and {r.inertia for r in got} == {0} and len(got) == 40
    assert centroids.inertia(vectors(spark, rows[:0])).count() == 0


def test_transform_keeps_distances_and_orders_coefficients():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-99, 99, (2, 64))
    x, y = centroids.transform(np.stack([a, b]))
    assert ((x - y) ** 2).sum() == 64 * ((a - b) ** 2).sum() and x[0] == a.sum()
    rows = centroids.transform(np.eye(64, dtype=np.int64)).T
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(64))
