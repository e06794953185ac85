"""Album list page: search, filter, status, sort, page in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfmark.operators import browse as br


def browse(albums: DataFrame, registry: DataFrame, results: DataFrame, text: str = "", kind: str = "all",
           sort_by: str = "artist", page: int = 1, per_page: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, page facts). Status is looked up for the rows of the page only,
    unless the sort needs it."""
    found = br.filter_albums(br.search(albums, text), kind, results, registry)
    if sort_by in ("last_scanned", "last_matched"):
        rows = br.album_page(br.with_status(found, registry, results), page, per_page, sort_by)
    else:
        wanted = br.album_page(found, page, per_page, sort_by)
        keys = wanted.select("album_key")
        rows = br.with_status(wanted, registry.join(keys, "album_key", "left_semi"),
                              results.join(keys, "album_key", "left_semi")).orderBy(*br.sort_order(sort_by))
    return rows, br.page_info(found, page, per_page)
