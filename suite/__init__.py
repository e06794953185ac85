"""Registered queries over the given tables, each with an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def _tuned(fn: Query) -> Query:
    return lambda spark, sf_dir: fn(tune(spark), sf_dir)


def registered() -> dict[str, tuple[Query, str | None]]:
    """Query name to (Spark function, SQL or None)."""
    from suite import q_albums, q_browse, q_genres, q_history, q_jobs, q_matching, q_quality, q_streaming, q_suggest
    out: dict[str, tuple[Query, str | None]] = {}
    for module in (q_albums, q_genres, q_matching, q_suggest, q_quality, q_jobs, q_history, q_browse, q_streaming):
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = (_tuned(pair[0]), pair[1])
    return out
