"""Album lists with status, search, filters, sorting and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.common import latest
from shelfmark.schemas import MATCHED_STATUSES


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(albums: DataFrame, text: str) -> DataFrame:
    """Albums whose artist or title contains the text, without case."""
    if not text:
        return albums
    pattern = f"%{escape_like(text)}%"
    return albums.where(F.col("artist").ilike(pattern) | F.col("album").ilike(pattern))


def with_status(albums: DataFrame, registry: DataFrame, results: DataFrame) -> DataFrame:
    """Scan and match status of each album from the registry and its latest result."""
    scans = registry.select("album_key", "last_scanned", "scan_status", F.col("error_message").alias("scan_error"))
    newest = latest(results, ["album_key"], ["created_at", "job_id"], ["status", "confidence", "created_at"])
    newest = newest.select("album_key", F.col("status").alias("batch_status"),
                           F.col("confidence").alias("match_confidence"), F.col("created_at").alias("last_matched"))
    return (albums.join(scans, "album_key", "left").join(newest, "album_key", "left")
            .withColumn("scan_status", F.when(F.col("last_scanned").isNull() & F.col("scan_status").isNull(),
                                              F.lit("never_scanned"))
                        .otherwise(F.coalesce("scan_status", F.lit("scanned"))))
            .withColumn("match_status", F.when(F.col("batch_status").isin(MATCHED_STATUSES), "matched")
                        .otherwise("never_matched"))
            .withColumn("display_status", display_status("scan_error", "batch_status")))


def display_status(scan_error: str, batch_status: str) -> Column:
    """error, review, matched or never."""
    s = F.col(batch_status)
    return (F.when(F.coalesce(F.col(scan_error), F.lit("")) != "", "error").when(s == "needs_review", "review")
            .when(s.isin(MATCHED_STATUSES), "matched").otherwise("never"))


def display_status_by_confidence(scan_error: str, last_matched: str, confidence: str) -> Column:
    """Older form: matched from 80 % on, with the day of the match."""
    day = F.date_format(F.col(last_matched), "yyyy-MM-dd")
    return (F.when(F.coalesce(F.col(scan_error), F.lit("")) != "", "Scan Error")
            .when(F.col(last_matched).isNull(), "Never Matched")
            .when(F.col(confidence) >= 80, F.concat(F.lit("Matched "), day)).otherwise("Needs Review"))


def filter_albums(albums: DataFrame, kind: str, results: DataFrame | None = None, registry: DataFrame | None = None
                  ) -> DataFrame:
    """all, review, matched, never, no_artwork or errors."""
    if kind == "review":
        return albums.join(results.where("status = 'needs_review'"), "album_key", "left_semi")
    if kind == "matched":
        return albums.join(results.where(F.col("status").isin(MATCHED_STATUSES)), "album_key", "left_semi")
    if kind == "never":
        return albums.join(results.select("album_key").where("album_key IS NOT NULL"), "album_key", "left_anti")
    if kind == "no_artwork":
        return albums.where("NOT coalesce(has_artwork, false)")
    if kind == "errors":
        return albums.join(registry.where("coalesce(error_message, '') <> ''"), "album_key", "left_semi")
    return albums


def sort_order(sort_by: str) -> list[Column]:
    """Sort columns; blank values come last and the key breaks ties."""
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""
    orders = {
        "artist": [blank("artist"), F.asc("artist"), F.asc("album")],
        "album": [blank("album"), F.asc("album"), F.asc("artist")],
        "year": [F.col("year").isNull(), F.desc("year"), F.asc("artist")],
        "last_scanned": [F.desc_nulls_last("last_scanned")],
        "last_matched": [F.desc_nulls_last("last_matched")],
    }
    return [*orders.get(sort_by, orders["artist"]), F.asc("album_key")]


def album_page(albums: DataFrame, page: int = 1, per_page: int = 50, sort_by: str = "artist") -> DataFrame:
    """One page of an already searched and filtered list."""
    return albums.orderBy(*sort_order(sort_by)).offset((page - 1) * per_page).limit(per_page)


def album_page_after(albums: DataFrame, after: tuple[str, str, str] | None, per_page: int = 50) -> DataFrame:
    """Next page in artist order after (artist, album, key) of the last row shown.

    Deep pages by offset sort and skip all rows before them; this reads only
    what follows.
    """
    rows = albums.withColumn("_blank", (F.coalesce(F.col("artist"), F.lit("")) == "").cast("int"))
    if after is not None:
        artist, album, key = after
        mark = F.struct(F.lit(int(not artist)), F.lit(artist or ""), F.lit(album or ""), F.lit(key))
        here = F.struct(F.col("_blank"), F.coalesce("artist", F.lit("")), F.coalesce("album", F.lit("")),
                        F.col("album_key"))
        rows = rows.where(here > mark)
    return (rows.orderBy("_blank", F.coalesce("artist", F.lit("")), F.coalesce("album", F.lit("")), "album_key")
            .limit(per_page).drop("_blank"))


def page_info(albums: DataFrame, page: int, per_page: int) -> DataFrame:
    """One row: total, pages, whether there is a page before and after."""
    total = albums.agg(F.count(F.lit(1)).alias("total"))
    return (total.withColumn("page", F.lit(page)).withColumn("per_page", F.lit(per_page))
            .withColumn("total_pages", F.ceil(F.col("total") / per_page))
            .withColumn("has_prev", F.lit(page > 1)).withColumn("has_next", F.lit(page * per_page) < F.col("total")))


def at_threshold(scored: DataFrame, threshold: float, column: str = "confidence") -> DataFrame:
    """Rows at or above a confidence."""
    return scored.where(F.col(column) >= threshold)


def sample_albums(albums: DataFrame, n: int = 5) -> DataFrame:
    """First albums by key."""
    return albums.orderBy("album_key").limit(n)
