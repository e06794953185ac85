"""Registry and cache as keyed state of a stream.

Both use ``transformWithState``: each album (each cached answer) has its own entry in the state store, a batch touches
the keys of its own rows only, and nothing is rewritten whole. What changed leaves as rows of an append-only log; the
newest row of a key is its current state (``latest``). All times come from the rows, so a batch that runs again after a
failure gives the same rows.

State needs RocksDB, which spills to disk; its snapshots go to the stream's checkpoint folder, which must be shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.functions.tags import cache_key
from shelfmark.sources import cache as ch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Digests of paths in one entry of the state on average, and the letters of one digest.
BUCKET, DIGEST = 64, 32

CHANGES = ("album_key string, artist string, album string, action string, n_paths long, hash_hi decimal(38,0), "
           "hash_lo decimal(38,0), first_discovered timestamp, last_scanned timestamp, seq long")
CACHE_EVENTS = ("cache_key string, artist string, album string, source string, genres array<string>, confidence double, "
                "weight double, event string, created_at timestamp, expires_at timestamp, seq long")


class AlbumState(StatefulProcessor):
    """One entry an album: its path fingerprint and times; and the set of paths seen, in buckets of their digests.

    A call to the state store costs far more than a lookup in a short text, so a batch reads and writes the buckets
    of its paths, not each path. Buckets are split as the album grows and hold ``BUCKET`` digests on average.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.album = handle.getValueState("album", "artist string, title string, n long, hi string, lo string, first long, "
                                          "last long, seq long, buckets int")
        self.paths = handle.getMapState("paths", "bucket int", "digests string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.album.get()
        known = held is not None
        artist, title, n, hi, lo, first, last, seq, buckets = held if known else (None, None, 0, "0", "0", None, None, 0, 0)
        hi, lo, before = int(hi), int(lo), n
        for part in rows:  # batches of one album's rows; its sums are all that is kept between them
            seen_at = part["seen_at"].to_numpy(dtype="datetime64[ns]")
            seen_at = seen_at[~np.isnat(seen_at)].view("int64")
            if len(seen_at):
                first = min(x for x in (first, int(seen_at.min()) // 1000) if x is not None)
                last = max(x for x in (last, int(seen_at.max()) // 1000) if x is not None)
            artist = min((x for x in [artist, *part["artist"].tolist()] if isinstance(x, str)), default=None)
            title = min((x for x in [title, *part["album"].tolist()] if isinstance(x, str)), default=None)
            asked = {hashlib.md5(x.encode()).hexdigest() for x in part["file_path"].tolist() if isinstance(x, str)}
            for digest in self._unseen(asked, buckets):
                n, hi, lo = n + 1, hi + int(digest[:15], 16), lo + int(digest[15:30], 16)
            buckets = self._split(n, max(buckets, 1 if n else 0))
        seq += 1
        self.album.update((artist, title, n, str(hi), str(lo), first, last, seq, buckets))
        fresh = n > before
        action = "new" if not known else "updated" if fresh else "same"
        yield pd.DataFrame({"album_key": [key[0]], "artist": [artist], "album": [title], "action": [action], "n_paths": [n],
                            "hash_hi": [Decimal(hi)], "hash_lo": [Decimal(lo)], "first_discovered": [_time(first)],
                            "last_scanned": [_time(last)], "seq": [seq]})

    def _bucket(self, number: int) -> list[str]:
        held = self.paths.getValue((number,))
        return [] if held is None else [held[0][i:i + DIGEST] for i in range(0, len(held[0]), DIGEST)]

    def _unseen(self, asked: set[str], buckets: int) -> list[str]:
        """The digests that are new to the album; they are added."""
        dealt: dict[int, list[str]] = {}
        for digest in asked:
            dealt.setdefault(_place(digest, max(buckets, 1)), []).append(digest)
        out = []
        for number, own in dealt.items():
            held = self._bucket(number) if buckets else []
            fresh = sorted(set(own).difference(held))
            if fresh:
                self.paths.updateValue((number,), ("".join(held + fresh),))
                out += fresh
        return out

    def _split(self, n: int, buckets: int) -> int:
        """Deal the digests to more buckets if these have become too long; one old bucket is read at a time."""
        more = buckets
        while n > BUCKET * more:
            more *= 2
        for number in range(buckets if more > buckets else 0):
            dealt: dict[int, list[str]] = {number: []}
            for digest in self._bucket(number):
                dealt.setdefault(_place(digest, more), []).append(digest)
            for place, own in dealt.items():
                self.paths.updateValue((place,), ("".join(own),))
        return more

    def close(self) -> None:
        pass


class CacheState(StatefulProcessor):
    """One entry a key: the newest answer. A timer at its end in event time emits the expiry and drops the entry."""

    def __init__(self, ttl_hours: int) -> None:
        self.ttl = ttl_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "artist string, album string, source string, genres array<string>, "
                                          "confidence double, weight double, created long, expires long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        best = None
        for part in rows:
            for row in part.itertuples(index=False):  # all answers of one key in one batch
                genres = None if row.genres is None else [str(x) for x in row.genres]
                rank = (_micros(row.created_at), row.confidence, row.weight, genres or [])
                if best is None or rank > best[0]:
                    best = (rank, (row.artist, row.album, row.source, genres, row.confidence, row.weight))
        created = best[0][0]
        if held is not None and held[6] > created:
            return
        seq = (held[8] if held is not None else 0) + 1
        entry = (*best[1], created, created + self.ttl, seq)
        self.entry.update(entry)
        self.handle.registerTimer(_timer(entry[7]))
        yield self._row(key, entry, "stored")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            return
        entry = self.entry.get()
        if _timer(entry[7]) <= expiredTimerInfo.getExpiryTimeInMs():  # else a newer answer has a timer of its own
            self.entry.clear()
            yield self._row(key, (*entry[:8], entry[8] + 1), "expired")

    def _row(self, key, entry, event: str) -> pd.DataFrame:
        artist, album, source, genres, confidence, weight, created, expires, seq = entry
        return pd.DataFrame({"cache_key": [key[0]], "artist": [artist], "album": [album], "source": [source],
                             "genres": [genres], "confidence": [confidence], "weight": [weight], "event": [event],
                             "created_at": [_time(created)], "expires_at": [_time(expires)], "seq": [seq]})

    def close(self) -> None:
        pass


def _place(digest: str, buckets: int) -> int:
    """The bucket of a digest; of twice as many buckets it is the same one or the one ``buckets`` further on."""
    return int(digest[:15], 16) % buckets


def _micros(stamp: pd.Timestamp) -> int:
    """Microseconds since 1970 of a timestamp; the session's zone is UTC."""
    return pd.Timestamp(stamp).value // 1000


def _time(micros: int | None) -> pd.Timestamp | None:
    return pd.NaT if micros is None else pd.Timestamp(micros, unit="us")


def _timer(micros: int) -> int:
    """Timers count milliseconds; the first one at or after the time."""
    return -(-micros // 1000)


def _start(spark: SparkSession, changes: DataFrame, out: str, checkpoint: str):
    """Append the changes to the log at ``out`` until all that is there has been read. The query is returned, running."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the query keeps the settings it starts with
    try:
        return (changes.writeStream.outputMode("append").format("parquet").option("path", out)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def album_changes(files: DataFrame) -> DataFrame:
    """A row for each album and batch: new, updated (paths never seen before) or same, with the state after the batch.

    ``files``: album_key, artist, album, file_path, seen_at. A path that comes again changes nothing.
    """
    return (files.select("album_key", "artist", "album", "file_path", "seen_at").groupBy("album_key")
            .transformWithStateInPandas(AlbumState(), CHANGES, "append", "None"))


def start_registry(files: DataFrame, out: str, checkpoint: str):
    """Keep the registry up to date with arriving files; its changes are appended to ``out``."""
    return _start(files.sparkSession, album_changes(files), out, checkpoint)


def cache_events(answers: DataFrame, ttl_hours: int = ch.DEFAULT_TTL_HOURS, delay: str = "0 seconds") -> DataFrame:
    """``stored`` for each answer that is the newest of its key, ``expired`` when event time passes its end.

    ``answers``: artist, album, source, genres, confidence, weight, created_at. Of several answers of a key the one
    with the latest time counts; event time is the latest ``created_at`` less ``delay``.
    """
    keyed = answers.withColumn("created_at", F.col("created_at").cast("timestamp")).where("created_at IS NOT NULL").select(
        cache_key("artist", "album", "source").alias("cache_key"), "artist", "album", "source", "genres",
        "confidence", "weight", "created_at")
    return (keyed.withWatermark("created_at", delay).groupBy("cache_key")
            .transformWithStateInPandas(CacheState(ttl_hours), CACHE_EVENTS, "append", "EventTime"))


def start_cache(answers: DataFrame, out: str, checkpoint: str, ttl_hours: int = ch.DEFAULT_TTL_HOURS):
    """Keep the source cache up to date with arriving answers; its events are appended to ``out``."""
    return _start(answers.sparkSession, cache_events(answers, ttl_hours), out, checkpoint)


def latest(log: DataFrame, key: str) -> DataFrame:
    """The newest row of each key of a change log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(key, "r.*")


def live_entries(log: DataFrame) -> DataFrame:
    """The cached answers that have not expired."""
    return latest(log, "cache_key").where("event = 'stored'")
