"""SimHash near-duplicates through pigeonhole blocks.

1. Every text gets a 64-bit fingerprint: a bit is set if more than half of its word shingles' hashes have it set.
2. Equal fingerprints collapse to one node, so copies never meet each other.
3. Blocks: a fingerprint is split into four blocks of 16 bits. Two fingerprints that differ in at most two bits agree in
   at least two blocks, so each node is filed under its six pairs of blocks, and nodes under one key are joined.
4. Verification: under a key of up to ``PAIR_LIMIT`` nodes all pairs are compared by Hamming distance. A larger one, as near
   copies make it, is split again by its other 32 bits: two of its nodes differ in at most two of them exactly if some
   value is within one bit of both. Each node is filed under its own 33 values inside the key; a value has at most 33
   nodes whatever the data. Its least node stands for it, the others are members, and the distance of each such link is
   checked too. A group of many near copies thus costs at most 6 x 33 rows a node, never a square.
5. Connected components of the links; each gets the least doc_id of its documents.

Defined results: a null or blank text has fingerprint 0, which is linked like any other. Rows with a null doc_id get
their component's id but can't name one; a component of such rows only has a null id. Repeated rows stay repeated rows.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ROW, cut, one_table, raw_texts, with_rows, without
from shelfmark.llm.graph import components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
BLOCK_BITS = 16
# Keys of more nodes are split by their other bits, which gives the same links from fewer rows.
PAIR_LIMIT = 32
_CHUNK = 1 << 16


def simhash(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text as an unsigned integer. bytes.lower and bytes.split treat ASCII only."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start:start + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, column in one_table(batches, ["doc_id", "text"]):
        found = np.array([simhash(raw) for raw in raw_texts(column)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(nodes: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all of ``nodes(fp)``, distinct, which differ in at most two bits."""
    count = 64 // BLOCK_BITS
    blocks = [((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * k) for k in range(count)]
    masks = F.array(*[F.lit(_signed(sum(pair))) for pair in combinations(blocks, count - MAX_DISTANCE)])
    filed = nodes.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("table", "key"))
    sizes = cut(filed.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = cut(filed.join(sizes, ["table", "key"]))
    small, large = shared.where(F.col("size") <= pair_limit), shared.where(F.col("size") > pair_limit)
    pairs = (small.select("table", "key", F.col("fp").alias("a"))
             .join(small.select("table", "key", F.col("fp").alias("b")), ["table", "key"]).where("a < b").select("a", "b"))
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    values = (large.select("table", "key", "fp", F.explode(near).alias("value"))
              .where(F.col("value").bitwiseAND(F.get(masks, F.col("table"))) == F.col("key")))
    # The table and the value fix the key, as the value agrees with it.
    members = (values.groupBy("table", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
               .select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b")))
    return (pairs.unionByName(members)
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``."""
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp")))
    rooted = cut(nodes.join(roots, nodes.fp == roots.node, "left")
                 .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    firsts = cut(rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id")))
    named = cut(rooted.join(firsts, rooted.root == firsts.r).select(F.col("fp").alias("f"), "component_id"))
    return (prints.join(named, prints.fp == named.f)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_firsts(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the least doc_id, with the columns of ``docs``.

    Rows are told apart by a key of their own: without a doc_id they come after those with one, and rows that share a
    doc_id are judged each by its text.
    """
    rows = with_rows(docs, "near_dedup_rows")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW).alias("doc_id")
    copies = near_duplicates(rows.select(own, "text")).where("doc_id <> component_id")
    return without(rows, copies.select(F.col("doc_id")[ROW].alias("gone")))
