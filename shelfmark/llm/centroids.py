"""Clusters of vectors around centroids, found by progressive search in the Walsh-Hadamard domain.

Components become integers, ``floor(64 x)``. The Walsh-Hadamard transform of a vector of 64 integers is 64 integers again,
and squared distances of transforms are 64 times those of the vectors (Hel-Or and Hel-Or, Real-Time Pattern Matching Using
Projection Kernels, 2005). Coefficients are taken coarse to fine, by their number of sign changes: what a centroid has
summed up so far is a lower bound of its distance, so a centroid that is beyond the whole distance of the most promising
one is strictly worse and leaves; the others go on to all 64 coefficients. All sums are integers, so nothing is lost by
rounding and ties are real ties.

Each round is one job over the written integers. Tasks keep a sum of components for each centroid and send
``CLUSTERS * 65`` numbers, whatever they read; the driver holds the centroids only.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out. A null
id counts as an empty text when centroids are drawn; of equal ids the smaller vector goes first. Repeated rows keep their
number. With fewer vectors than centroids each vector starts one; without vectors the result is empty. Of centroids at the
same distance the one with the smaller number is taken. Components of 2**50 or more are an error, and so are distances
that exceed a long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
# Coefficients known after each step.
STEPS = (4, 8, 16, 32, DIM)
# Largest component whose 64-fold distances fit in 64 bits; beyond it Python's integers are used.
NARROW = 1 << 24
_WIDEST = float(1 << 50)


def _by_sign_changes() -> np.ndarray:
    """Rows of the Hadamard matrix in Sylvester's order, those with fewer sign changes first."""
    row = np.arange(DIM)
    odd = np.bitwise_count(row[:, None] & row[None, :]) % 2
    return np.argsort((odd[:, 1:] != odd[:, :-1]).sum(1), kind="stable")


ORDER = _by_sign_changes()


def transform(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard coefficients of each row of integers, coarse to fine."""
    out = rows.reshape(len(rows), *[2] * 6)
    for axis in range(1, 7):
        a, b = np.take(out, 0, axis), np.take(out, 1, axis)
        out = np.stack([a + b, a - b], axis)
    return out.reshape(len(rows), DIM)[:, ORDER]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector; both sides are transforms."""
    n, k = len(vectors), len(centroids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, which = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = np.zeros(n * k, vectors.dtype)
    bound, done = None, 0
    for upto in STEPS:
        gap = vectors[who, done:upto] - centroids[which, done:upto]
        part = part + (gap * gap).sum(1)
        done = upto
        if bound is None:  # every centroid is still there
            lead = part.reshape(n, k).argmin(1)
            rest = vectors[:, done:] - centroids[lead, done:]
            bound = part.reshape(n, k)[np.arange(n), lead] + (rest * rest).sum(1)
        stays = (part <= bound[who]).astype(bool)
        who, which, part = who[stays], which[stays], part[stays]
    best = np.minimum.reduceat(part, np.flatnonzero(np.r_[True, who[1:] != who[:-1]]))
    ties = np.flatnonzero((part == best[who]).astype(bool))  # by vector, then by centroid
    first = ties[np.r_[True, who[ties][1:] != who[ties][:-1]]]
    return which[first], best // DIM


def _integers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIM)


def assign(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` over integer vectors, exact at any size."""
    centres = np.array(centroids, np.int64).reshape(-1, DIM)
    wide = max(np.abs(rows).max(initial=0), np.abs(centres).max(initial=0)) > NARROW
    kind = object if wide else np.int64
    return nearest(transform(rows.astype(kind)), transform(centres.astype(kind)))


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can be used, v as integers."""
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(SCALE))
        return F.when(F.abs(scaled) < _WIDEST, F.floor(scaled)).otherwise(
            F.raise_error(F.lit("a component of a vector is too large")).cast("long"))

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return (vectors.select("vec_id", "embedding")
            .where((F.size("embedding") == DIM) & F.coalesce(F.forall("embedding", usable), F.lit(False)))
            .select("vec_id", F.transform("embedding", whole).alias("v")))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The vectors with the least SHA-256 of ``1:<vec_id>``; at most ``clusters`` rows reach the driver."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in rows.select("v", mark.alias("mark")).orderBy("mark", "v").limit(clusters).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, DIM + 1), object)  # Python's integers, the last one counts
        for batch in batches:
            own = _integers(batch.column("v"))
            cluster, _ = assign(own, centroids)
            for c in np.unique(cluster):
                mine = own[cluster == c]
                total[c] += np.append(mine.sum(0), len(mine)).astype(object)
        at = np.flatnonzero(total.ravel() != 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // (DIM + 1), pa.int32()), pa.array(at % (DIM + 1), pa.int32()),
             pa.array(total.ravel()[at].tolist(), pa.int64())], names=["cluster", "place", "amount"])

    found = (rows.select("v").mapInArrow(sums, "cluster int, place int, amount long").groupBy("cluster", "place")
             .agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect())  # CLUSTERS * 65 rows at most
    total = {(r["cluster"], r["place"]): int(r["amount"]) for r in found}
    return [[total.get((c, i), 0) // total[c, DIM] for i in range(DIM)] if (c, DIM) in total else centroid
            for c, centroid in enumerate(centroids)]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every usable vector, written to the shared folder, and the last centroids."""
    rows = materialize(integers(vectors), "vectors")
    centroids = first_centroids(rows, clusters)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = assign(_integers(batch.column("v")), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)),
                                                  pa.array(distance.tolist(), pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def inertia(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """``cluster`` with the sums of distances of each cluster and of all, and a digest of each last centroid."""
    found, centroids = cluster(vectors, clusters, rounds)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid at most
    facts = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
             for c, v in enumerate(centroids)]
    table = found.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(  # a row for each centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
