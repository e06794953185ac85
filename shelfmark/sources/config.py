"""Small configuration documents, read through Spark so that any file system works."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from shelfmark.refdata import Taxonomy, with_default_options


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_taxonomy(spark: SparkSession, path: str | None = None) -> Taxonomy:
    """Taxonomy from a document, or the built-in one."""
    return Taxonomy.default() if path is None else Taxonomy.from_json(_read_text(spark, path))


def save_taxonomy(spark: SparkSession, taxonomy: Taxonomy, path: str) -> None:
    _write_text(spark, path, taxonomy.to_json())


def load_options(spark: SparkSession, path: str | None = None) -> dict[str, object]:
    """Job options over their defaults."""
    return with_default_options(None if path is None else json.loads(_read_text(spark, path)))


def enabled_sources(options: dict[str, object]) -> list[str]:
    """Sources not switched off under ``sources: {name: {enabled: false}}``."""
    sources = options.get("sources", {})
    return [name for name, entry in sources.items() if not isinstance(entry, dict) or entry.get("enabled", True)]
