"""Inputs: file listings and tag tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators.albums import scan_tracks


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Recursive listing with size and time; file contents are pruned, never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select(F.regexp_replace("path", "^file:", "").alias("file_path"), F.col("length").alias("file_size"),
                    F.col("modificationTime").alias("modified_at")))


def list_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below a folder."""
    return scan_tracks(list_files(spark, path))


def read_raw_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Table of tag bags written by whatever reads the audio files."""
    return spark.read.schema(schemas.TRACKS_RAW).parquet(path)
