"""Cache of source answers with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.tags import cache_key
from shelfmark.operators.common import latest
from shelfmark.operators.matching import unexpired

DEFAULT_TTL_HOURS = 24


def entries(votes: DataFrame, now: Column, ttl_hours: int = DEFAULT_TTL_HOURS) -> DataFrame:
    """Cache rows for fresh source answers: artist, album, source, genres, confidence, weight."""
    expires = now + F.make_interval(hours=F.lit(ttl_hours))
    return votes.select(cache_key("artist", "album", "source").alias("cache_key"), "artist", "album", "source",
                        "genres", "confidence", "weight", now.alias("created_at"), expires.alias("expires_at"))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache with the newest entry per key."""
    return latest(cache.unionByName(new), ["cache_key"], ["created_at", "expires_at"]).select(*cache.columns)


def get(cache: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Live entries for the wanted (artist, album, source) rows."""
    keys = wanted.select(cache_key("artist", "album", "source").alias("cache_key")).distinct()
    return unexpired(cache, now).join(keys, "cache_key", "left_semi")


def cleared(cache: DataFrame) -> DataFrame:
    """The empty cache."""
    return cache.where(F.lit(False))
