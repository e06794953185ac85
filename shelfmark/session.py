"""Session helpers: where shared files go, and when a broadcast hint is allowed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is hinted as broadcast only when its row count is known on the driver
# and stays under this bound. Anything else is left to Catalyst and AQE, which
# decide on measured sizes and fall back to a shuffled join.
BROADCAST_ROW_BOUND = 100_000

CHECKPOINT_DIR = "spark.checkpoint.dir"


# Session settings that suit these operators. Wide expressions over tag bags and
# rule tables generate methods past the size the JVM compiles; with the lower
# limit Spark splits such expressions instead of fusing them into one method.
# AQE is on by default and handles skewed joins and partition sizes.
RECOMMENDED = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="shelfmark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for intermediate results that several branches read: the written table
    survives the loss of an executor and carries exact sizes for AQE.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows of an input that has fewer splits than the session has cores.

    For small files read by compute-heavy expressions. Inputs with enough splits
    are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hinted(df: DataFrame, known_rows: int) -> DataFrame:
    """Broadcast hint for a side whose size the driver already knows."""
    return F.broadcast(df) if known_rows <= BROADCAST_ROW_BOUND else df
