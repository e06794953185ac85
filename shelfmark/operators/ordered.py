"""Per-key order computations that do not put a whole key into one task.

A window partitioned by key alone sorts every row of that key in one task. With
a third of all rows under one key that task decides the run time. Here rows are
first cut into ranges of (key, time, tie), so that a key with many rows takes
many ranges, however close in time they are. The window runs inside a range; a
second, small window over one row per key and range carries counts, sums and
last values across their borders. Results equal the plain window's. Only rows
that agree in key, time and tie cannot be told apart and share a range.

Borders come from a sample of the rows, so the cut rows are written to the
shared folder once: a task that runs again reads the same ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shelfmark.session import materialize

_PART = "_part"


def ranged(df: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the number of its range of (key, order), which grows with the order inside a key.

    There are ``parts`` ranges, as many as shuffle partitions by default.
    """
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(count, key, *order).withColumn(_PART, F.spark_partition_id())
    return materialize(cut, "ranges")


def _earlier(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def _with_carried(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """Rows of ``ranged`` with the columns of their key and range; a null key is a key like others."""
    other = carried.withColumnsRenamed({key: "_key", _PART: "_of"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col(_PART) == F.col("_of"))).drop("_key", "_of")


def numbered(df: DataFrame, key: str, ts: str, tie: list[str], name: str = "row_number",
             parts: int | None = None) -> DataFrame:
    """Position of each row within its key, in (ts, tie) order, starting at 1."""
    rows = ranged(df, key, [ts, *tie], parts)
    local = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, _PART).orderBy(ts, *tie)))
    sizes = rows.groupBy(key, _PART).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(key, _PART, F.coalesce(F.sum("_size").over(_earlier(key)), F.lit(0)).alias("_before"))
    return (_with_carried(local, offsets, key)
            .withColumn(name, (F.col("_n") + F.col("_before")).cast("bigint")).drop("_n", "_before", _PART))


def with_previous(df: DataFrame, key: str, ts: str, tie: list[str], value: str, name: str = "previous",
                  number: str | None = None, total: str | None = None, parts: int | None = None) -> DataFrame:
    """The ``value`` column of the row before this one in its key; null for the first.

    With ``number`` the row's position is returned too, with ``total`` the number
    of rows of its key, both from the same pass.
    """
    rows = ranged(df, key, [ts, *tie], parts)
    inside = Window.partitionBy(key, _PART).orderBy(ts, *tie)
    local = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_prev", F.lag(value).over(inside))
    ends = rows.groupBy(key, _PART).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(ts, *tie)).alias("_end"),
                                        F.count(F.lit(1)).alias("_size"))
    carried = ends.select(
        key, _PART, F.lag("_end").over(Window.partitionBy(key).orderBy(_PART)).alias("_carry"),
        F.coalesce(F.sum("_size").over(_earlier(key)), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(key)).alias("_total"))
    out = (_with_carried(local, carried, key)
           .withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")["v"]).otherwise(F.col("_prev"))))
    if number:
        out = out.withColumn(number, (F.col("_n") + F.col("_before")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.drop("_n", "_prev", "_carry", "_before", "_total", _PART)


def sum_before(df: DataFrame, key: str, order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of the same key before this one; 0 for the first."""
    rows = ranged(df, key, order, parts)
    inside = Window.partitionBy(key, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = rows.groupBy(key, _PART).agg(F.sum(value).alias("_sum"))
    carried = sums.select(key, _PART, F.coalesce(F.sum("_sum").over(_earlier(key)), F.lit(0)).alias("_before"))
    return _with_carried(local, carried, key).withColumn(name, F.col("_local") + F.col("_before")).drop(
        "_local", "_before", _PART)


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, name: str = "recent",
                   parts: int | None = None) -> DataFrame:
    """Rows of the same key in the ``seconds`` before and including each row; null for rows without key or time.

    A trailing range is the difference of two running counts, at its end and
    before its start. Rows of one key and time are counted before they are
    shuffled, so the ordered table has two rows per distinct time: one where the
    range starts, ahead of the rows of that time, and one where it ends.
    """
    rows = df.withColumn("_us", F.unix_micros(F.col(ts)))
    counts = rows.where(F.col(key).isNotNull() & F.col("_us").isNotNull()).groupBy(key, "_us").agg(
        F.count(F.lit(1)).alias("_rows"))
    start = F.struct((F.col("_us") - seconds * 1_000_000).alias("_place"), F.lit(0).alias("_end"), F.lit(0).cast("long").alias("_n"))
    end = F.struct(F.col("_us").alias("_place"), F.lit(1).alias("_end"), F.col("_rows").alias("_n"))
    sums = sum_before(counts.select(key, F.col("_us").alias("_at"), F.inline(F.array(start, end))), key, ["_place", "_end"],
                      "_n", "_until", parts)
    found = sums.groupBy(F.col(key).alias("_key"), "_at").agg(
        F.sum(F.when(F.col("_end") == 1, F.col("_until") + F.col("_n")).otherwise(-F.col("_until"))).cast("bigint").alias(name))
    return rows.join(found, (F.col(key) == F.col("_key")) & (F.col("_us") == F.col("_at")), "left").drop(
        "_us", "_key", "_at")
