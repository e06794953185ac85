"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import materialize, shared_dir, tune

# Rows of one Arrow batch. Texts may be long, so batches are kept small to bound the memory of a Python worker.
BATCH_ROWS = 512
_KEEP_WORDS = 1 << 19
ROW = "__shelfmark_row"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: the library's own and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: it is computed once and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def with_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key of each row in ``ROW``, written to the shared folder so that the keys stay the same."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` of ``with_rows`` but for the keys in ``dropped(gone)``, with the columns they came with."""
    return rows.join(cut(dropped), F.col(ROW) == F.col("gone"), "left_anti").drop(ROW)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5. Rows with 0 are held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The strings of a string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def one_table(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.Array]]:
    """The named columns of each batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(name) for name in names]


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """One object per Python worker and key, kept between tasks. Only for what may be lost or made again at any time."""
    held = sys.modules.setdefault("_shelfmark_worker", types.ModuleType("_shelfmark_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class WordHashes(dict):
    """Word to hash; forgets everything when it has grown to _KEEP_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEEP_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def platt(margins: np.ndarray, marks: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and intercept that make margins probabilities of a mark (Platt), by Newton steps with a small ridge."""
    if marks.min(initial=1) == marks.max(initial=0) or not len(marks):
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((p - marks) * margins).sum() + a - 1, (p - marks).sum() + b])
        h = np.array([[(v * margins ** 2).sum() + 1, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(a), float(b)
