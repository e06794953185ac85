"""Helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Single-row frames side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = [n for f in frames for n in f.columns]
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def latest(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Row with the greatest ``order`` per key.

    ``max_by`` keeps one row per key and task before the shuffle, where a
    ranking window would send and sort every row of a hot key in one task.
    """
    rest = keep or [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
            .select(*keys, *[F.col("r")[c].alias(c) for c in rest]))


def first_by(df: DataFrame, keys: list[str], rank: Column, keep: list[str] | None = None) -> DataFrame:
    """Row with the least ``rank`` per key."""
    rest = keep or [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r"))
            .select(*keys, *[F.col("r")[c].alias(c) for c in rest]))


def unnest(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """One row per non-null element of a computed list.

    A plain ``explode`` makes the optimizer add a filter on the list's size and
    push it below, so an expensive list would be computed twice.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
