"""Versioned Parquet tables: upserts, partial refreshes and append-only logs.

Plain Parquet has no merge. A table is a folder of numbered versions; a change
writes the next one and readers take the highest complete version. A version
being read is never overwritten, so a failed write leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and rows of ``old`` whose key is not in ``new``."""
    return (old.join(new.select(*keys).distinct(), keys, "left_anti")
            .unionByName(new, allowMissingColumns=True))


def upsert_albums(albums: DataFrame, tracks: DataFrame, new_albums: DataFrame, new_tracks: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """Store scanned albums; all tracks of a stored album are replaced by the scanned ones."""
    kept = tracks.join(new_albums.select("album_key"), "album_key", "left_anti")
    return upsert(albums, new_albums, ["album_key"]), kept.unionByName(new_tracks, allowMissingColumns=True)


def refresh_albums(albums: DataFrame, tracks: DataFrame, scanned_albums: DataFrame, scanned_tracks: DataFrame,
                   keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert of the listed albums only."""
    wanted = keys.select("album_key").distinct()
    return upsert_albums(albums, tracks, scanned_albums.join(wanted, "album_key", "left_semi"),
                         scanned_tracks.join(wanted, "album_key", "left_semi"))


def retry_outcome(registry: DataFrame, scanned_albums: DataFrame) -> DataFrame:
    """Each album with a stored error: ``fixed`` when a new scan finds an artist, an album or a title."""
    failed = registry.where("coalesce(error_message, '') <> ''").select("album_key")
    named = [c for c in ("artist", "album", "title") if c in scanned_albums.columns]
    found = (scanned_albums.where(F.concat_ws("", *named) != "").select("album_key").distinct()
             .withColumn("found", F.lit(True)))
    return (failed.join(found, "album_key", "left")
            .select("album_key", F.when(F.col("found"), "fixed").otherwise("still_failed")
                    .alias("outcome")))


def refresh_failed(albums: DataFrame, tracks: DataFrame, registry: DataFrame, scanned_albums: DataFrame,
                   scanned_tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upsert of the albums that failed before and scan now. Returns (albums, tracks, counters)."""
    outcome = retry_outcome(registry, scanned_albums)
    out = refresh_albums(albums, tracks, scanned_albums, scanned_tracks, outcome.where("outcome = 'fixed'"))
    counters = outcome.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("outcome") == "fixed").alias("fixed"),
                           F.count_if(F.col("outcome") == "still_failed").alias("still_failed"))
    return *out, counters


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(
                jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(name[1:]))
    return sorted(done)


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write the next version of a table; returns its number."""
    done = _versions(df.sparkSession, path)
    number = (done[-1] if done else 0) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/v{number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Latest complete version of a table, or a given one."""
    done = _versions(spark, path)
    if not done:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{number or done[-1]}")


def write_run(tables: dict[str, DataFrame], path: str, run_column: str, run_id: str) -> None:
    """Write the rows of one run to its log tables, then the row that commits them.

    The rows go to a partition of the run and of this attempt; the commit row of the run, replaced by dynamic partition
    overwrite, names the attempt that counts. A run that is done again under its id takes the place of the first, and
    one that breaks off leaves rows that nobody reads. Rows of attempts that don't count stay until the folder expires.
    """
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        (df.withColumns({run_column: F.lit(run_id), "attempt": F.lit(attempt)}).write.mode("append")
         .partitionBy(run_column, "attempt").parquet(f"{path}/{name}"))
    spark = next(iter(tables.values())).sparkSession
    commit = spark.createDataFrame([(run_id, attempt)], f"{run_column} string, attempt string").coalesce(1)
    (commit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_column)
     .parquet(f"{path}/{run_column}_commits"))


def read_log(spark: SparkSession, path: str, name: str, run_column: str) -> DataFrame:
    """The rows of a log table that a commit row names. Runs that wrote no row to any table of that name have none."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    commits = spark.read.schema(f"attempt string, {run_column} string").parquet(f"{path}/{run_column}_commits")
    # partition values that look like numbers or dates are read as such
    rows = rows.withColumns({run_column: F.col(run_column).cast("string"), "attempt": F.col("attempt").cast("string")})
    return rows.join(commits.select(run_column, "attempt"), [run_column, "attempt"], "left_semi").drop("attempt")


def create_job(spark: SparkSession, job_id: str, name: str, total_albums: DataFrame, threshold: float,
               dry_run: bool, now: Column, options: str = "{}") -> DataFrame:
    """Job row; ``total_albums`` is the selected albums, counted where they are."""
    return total_albums.agg(F.count(F.lit(1)).alias("total_albums")).select(
        F.lit(job_id).alias("job_id"), F.lit(name).alias("name"), now.alias("created_at"), "total_albums",
        F.lit(float(threshold)).alias("confidence_threshold"), F.lit(dry_run).alias("dry_run"),
        F.lit("pending").alias("status"), F.lit(options).alias("options"))


def session_row(counters: DataFrame, session_id: str, started: Column, completed: Column) -> DataFrame:
    """Log row of a finished scan with the counters of the merge."""
    return counters.select(F.lit(session_id).alias("session_id"), started.alias("started_at"),
                           completed.alias("completed_at"), "discovered", "updated",
                           F.col("scanned").alias("total"), F.lit("completed").alias("status"))


def save_quality_report(scores: DataFrame, issues: DataFrame, report_id: str, now: Column, path: str) -> None:
    """One report row and all issue rows under the run's id; saved again they take the place of the first."""
    report = scores.select(F.lit(report_id).alias("report_id"), now.alias("created_at"), "total_albums",
                           "total_issues", "critical_issues", "warning_issues", "info_issues", "quality_score",
                           "consistency_score")
    write_run({"quality_reports": report, "quality_issues": issues}, path, "report_id", report_id)
