"""Benchmark decontamination by winnowing.

Words are hashed, and every run of ``GRAM`` words gets a hash. Of each ``SPAN - GRAM + 1`` neighbouring gram hashes the
least is kept, so any shared run of ``SPAN`` words leaves at least one equal fingerprint on both sides (Schleimer,
Wilkerson, Aiken, Winnowing, 2003). Items shorter than ``SPAN`` words are one gram of their own length, and documents are
looked up with every gram of such a length.

The document side drops fingerprints that no item can have by a bitmap of 2**BITMAP_BITS positions (2 MB at 24 bits, the
same at every benchmark size; a full bitmap only lets more rows into the join). What is left is joined to the item
fingerprints and each hit is extended to both sides; a run of SPAN equal words is a hit.

Defined results: null and wordless texts have no words, no hits and aren't contaminated; items without words never occur.
The windows of an item without id hit like any other; it is not among the items named. Items with one id and several texts count once if any text occurs. Each document row is judged
by itself, whatever its doc_id, so null and repeated ids are kept as they are. Empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ROW, WordHashes, cut, one_table, raw_texts, with_rows, without

SPAN = 13
GRAM = 5
BITMAP_BITS = 24
MAX_SHARE = 20  # contaminated if hit words are at least 1 / MAX_SHARE of all words

# A-Z become a-z; every other ASCII character that isn't a letter or digit separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_MULTIPLIER = 0x9E3779B97F4A7C15
CANDIDATE = "array<struct<fp: long, at: long, left: long, words: array<long>>>"


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    count = len(words) - size + 1
    found = np.full(max(count, 0), size, dtype=np.uint64)
    for k in range(size if count > 0 else 0):
        found = (found ^ words[k:k + count]) * np.uint64(_MULTIPLIER)
        found ^= found >> np.uint64(29)
    return found


def _winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost least hash of each window."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def _candidates(words: np.ndarray, lengths: list[int], bitmap: np.ndarray | None) -> list[dict]:
    """Fingerprints of a text with the words around them. ``lengths``: of grams; SPAN stands for winnowed grams."""
    out = []
    signed = words.view(np.int64)
    for length in lengths:
        size = GRAM if length == SPAN else length
        hashes = _gram_hashes(words, size)
        at = _winnow(hashes, SPAN - GRAM + 1) if length == SPAN else np.arange(len(hashes))
        if bitmap is not None:
            slot = (hashes[at] & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
            at = at[(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
        reach = SPAN - size if length == SPAN else 0
        for p in at.tolist():
            start = max(0, p - reach)
            out.append({"fp": int(hashes[p:p + 1].view(np.int64)[0]), "at": start, "left": p - start,
                        "words": signed[start:p + size + reach]})
    return out


def _hashed(raw: bytes, known: WordHashes) -> np.ndarray:
    words = raw.translate(_TABLE).split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


_CANDIDATE = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("left", pa.int64()),
                                 ("words", pa.list_(pa.int64()))]))


def _scan(id_name: str, lengths: list[int] | None, bitmap: bytes | None):
    """A function for mapInArrow: id, n_words, gram lengths and candidate fingerprints of each text.

    ``lengths`` None: of benchmark items, which have one gram length each.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        bits = None if bitmap is None else np.frombuffer(bitmap, dtype=np.uint8)
        for ids, column in one_table(batches, [id_name, "text"]):
            counts, found = [], []
            for raw in raw_texts(column):
                words = _hashed(raw, known)
                own = [min(len(words), SPAN)] if lengths is None else lengths
                counts.append(len(words))
                found.append(_candidates(words, own, bits) if len(words) else [])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(found, _CANDIDATE)], names=[id_name, "n_words", "found"])
    return scan


def _bitmap(items: DataFrame) -> bytes:
    """One bit for each slot that some item fingerprint falls into; of fixed size."""
    slot = F.col("fp").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    # bitmap_* count positions from 1 in buckets of 32,768 bits
    rows = (items.select((slot + 1).alias("s"))
            .groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s"))
                                                                      .alias("bits")).collect())
    out = bytearray(1 << (BITMAP_BITS - 3))
    for row in rows:
        start = (row["bucket"] - 1) * 4096
        out[start:start + 4096] = row["bits"]
    return bytes(out)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of joined fingerprints: row, start and end of the equal run, item_id."""
    for batch in batches:
        rows, starts, ends, items = [], [], [], []
        for r in batch.to_pylist():
            a, b, i, j = r["words"], r["item_words"], r["left"], r["item_left"]
            back = 0
            while back < min(i, j) and a[i - back - 1] == b[j - back - 1]:
                back += 1
            ahead = 0
            while ahead < min(len(a) - i, len(b) - j) and a[i + ahead] == b[j + ahead]:
                ahead += 1
            if back + ahead >= r["span"]:
                rows.append(r["row"])
                starts.append(r["at"] + i - back)
                ends.append(r["at"] + i + ahead)
                items.append(r["item_id"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
             pa.array(items, batch.schema.field("item_id").type)], names=["row", "start", "end", "item_id"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    scanned = benchmark.select("item_id", "text").mapInArrow(
        _scan("item_id", None, None), f"item_id {item_kind}, n_words long, found {CANDIDATE}")
    items = cut(scanned.select("item_id", F.least("n_words", F.lit(SPAN)).alias("span"), F.explode("found").alias("c"))
                .select("item_id", "span", F.col("c.fp").alias("item_fp"), F.col("c.left").alias("item_left"),
                        F.col("c.words").alias("item_words")).distinct())
    lengths = sorted(row["span"] for row in items.select("span").distinct().collect())  # at most SPAN rows
    found = cut(docs.select("doc_id", "text").mapInArrow(
        _scan("doc_id", lengths, _bitmap(items.select(F.col("item_fp").alias("fp")))),
        f"doc_id {doc_kind}, n_words long, found {CANDIDATE}"))
    found = found.withColumn("row", F.monotonically_increasing_id())  # stable: the checkpoint fixes the rows' order
    grams = found.select("row", F.explode("found").alias("c")).select("row", "c.*")
    hits = (grams.join(items, grams.fp == items.item_fp)
            .select("row", "at", "left", "words", "item_id", "span", "item_left", "item_words")
            .mapInArrow(_extend, f"row long, start long, end long, item_id {item_kind}"))
    # Runs of one document, merged: each adds what lies beyond the largest end before it.
    spans = (hits.groupBy(F.col("row").alias("hit_row"))
             .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
                  F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
             .select("hit_row", "item_ids", F.expr(
                 "aggregate(spans, named_struct('n', 0L, 'e', 0L), (s, x) -> named_struct("
                 "'n', s.n + greatest(0L, x.end - greatest(s.e, x.start)), 'e', greatest(s.e, x.end)), s -> s.n)")
                 .alias("n_hit")))
    joined = found.select("row", "doc_id", "n_words").join(spans, F.col("row") == F.col("hit_row"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                         ids.alias("item_ids"),
                         ((n_hit > 0) & (MAX_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with the columns they came with; each is judged by itself, whatever its doc_id."""
    rows = with_rows(docs, "decontamination_rows")
    bad = contamination(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark).where("contaminated")
    return without(rows, bad.select(F.col("doc_id").alias("gone")))
