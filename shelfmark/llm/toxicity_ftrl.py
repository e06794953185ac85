"""Toxicity by logistic regression with FTRL-proximal steps (McMahan et al., Ad Click Prediction, 2013).

Features are the words, neighbouring pairs and pairs with one word between, hashed to 2**BITS places; a place counts once
in a text. Each place has its own learning rate and the L1 term leaves most weights at zero, so the model is a few
thousand numbers in a table of fixed size, which is what is sent to the tasks.

The fit uses a bounded sample of labelled texts of the training fold: at most ``SAMPLE``, those with the least hash of
their id. They are dealt to ``SHARDS`` tasks by that hash; each makes its own passes and the weights are averaged
(McDonald et al., Distributed Training Strategies for the Structured Perceptron, 2010). The sums are scaled to
probabilities on the same sample. Scores are for all documents, whole texts.

Defined results: null and empty texts have the intercept's score. Repeated labels of a document count as toxic if any
says so. Without labels all scores are 0.5. Rows keep their number, extra columns are ignored, empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WordHashes, cut, fold, one_table, platt, raw_texts

BITS = 20
SAMPLE = 16_000
SHARDS = 2
PASSES = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.5

# Letters are lower-cased where they are ASCII; ASCII characters that aren't letters or digits separate words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def places(raw: bytes, known: WordHashes) -> np.ndarray:
    """The distinct hashed features of a text, sorted. The last place of the table is the intercept's and isn't given."""
    words = raw.translate(_TABLE).split()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = (h[:-1] * _PAIR) ^ h[1:]
    skips = (h[:-2] * _SKIP) ^ (h[2:] * _PAIR)
    every = np.concatenate([h, pairs, skips]) * _PAIR >> np.uint64(64 - BITS)
    found = np.unique(every.astype(np.uint32))
    return found[found < (1 << BITS) - 1]


def fit_shard(features: list[np.ndarray], toxic: list[int]) -> np.ndarray:
    """FTRL-proximal passes over the rows in their order; the weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) > L1, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rows = [np.append(f, (1 << BITS) - 1).astype(np.int64) for f in features]
    for _ in range(PASSES):
        for at, y in zip(rows, toxic):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, shards: int = SHARDS) -> np.ndarray:
    """The averaged and scaled weights as an array of 2**BITS numbers, the last one the intercept."""
    marks = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != 0)
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .withColumn("order", F.xxhash64("label_id")))
    chosen = marks.orderBy("order", "label_id").limit(size)  # at most `size` narrow rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for order, toxic, column in one_table(batches, ["order", "toxic", "text"]):
            found = [places(raw, known).tobytes() for raw in raw_texts(column)]
            yield pa.RecordBatch.from_arrays([order, toxic, pa.array(found, pa.binary())],
                                             names=["order", "toxic", "features"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "features"])
        w = fit_shard([np.frombuffer(f, dtype=np.uint32) for f in rows["features"]], rows["toxic"].tolist())
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "weight": w[at] / shards})

    features = cut(rows.select("order", "toxic", "text").mapInArrow(scan, "order long, toxic int, features binary"))
    fitted = (features.withColumn("shard", F.pmod("order", F.lit(shards))).groupBy("shard")
              .applyInPandas(lambda rows: fit(rows), "place long, weight double"))
    out = np.zeros(1 << BITS)
    for row in fitted.groupBy("place").agg(F.sum("weight").alias("weight")).collect():  # at most 2**BITS rows
        out[row["place"]] = row["weight"]

    sent = docs.sparkSession.sparkContext.broadcast(out)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, column in one_table(batches, ["toxic", "features"]):
            sums = [float(sent.value[np.frombuffer(f, dtype=np.uint32)].sum()) for f in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([toxic, pa.array(sums, pa.float64())], names=["toxic", "margin"])

    found = features.select("toxic", "features").mapInArrow(margins, "toxic int, margin double").toPandas()
    order = np.sort(found["margin"].to_numpy() + 1j * found["toxic"].to_numpy())  # rows come in any order
    slope, shift = platt(order.real + out[-1], order.imag)  # at most `size` rows
    out *= slope
    out[-1] += shift
    return out


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, size).astype(np.float32))  # 4 MB

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = WordHashes(), weights.value
        for ids, column in one_table(batches, ["doc_id", "text"]):
            sums = np.array([w[places(raw, known)].sum() for raw in raw_texts(column)], dtype=float) + float(w[-1])
            yield pa.RecordBatch.from_arrays([ids, pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))],
                                             names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
