"""Plain Python versions of the contracts, for small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import xxhash
from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that operators use for their own columns
                     T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("spans", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("row", T.StringType())])


def frame(spark, texts, ids=None):
    """A documents table with clashing extra columns."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * 6)
                                  for i, t in zip(ids, texts)], DOCS)


def prose(n, seed=0, size=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size * 50)}" for _ in range(n))


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    """Least doc_id reachable from each of (doc_id, fingerprint)."""
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i][1], nodes[j][1]):
                root[find(i)] = find(j)
    out = []
    for i in range(len(nodes)):
        ids = [nodes[j][0] for j in range(len(nodes)) if find(j) == find(i) and nodes[j][0] is not None]
        out.append(min(ids, default=None))
    return out


def contamination(texts, items):
    windows = {}
    for item, text in items:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        n = min(13, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[k:k + n]), set()).update([] if item is None else [str(item)])
    out = []
    for text in texts:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(words[k:k + n])]
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(scores, marks):
    pairs = sorted(zip(scores, marks))
    ranks = [k + 1 for k, (_, m) in enumerate(pairs) if m]
    n = len(ranks)
    return (sum(ranks) - n * (n + 1) / 2) / (n * (len(pairs) - n))


def best_fit_decreasing(counts, capacity):
    """Sequences that best fit by falling length opens, piece by piece."""
    rooms, opened = [0] * (capacity + 1), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            left = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            if left is None:
                left, opened = capacity, opened + 1
            else:
                rooms[left] -= 1
            rooms[left - length] += 1
    return opened
