"""Full quality analysis of a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from shelfmark.operators import quality as ql
from shelfmark.refdata import Taxonomy
from shelfmark.session import materialize
from shelfmark.sources import store


def analyse(albums: DataFrame, tracks: DataFrame | None, tax: Taxonomy, duplicates: bool = True
            ) -> dict[str, DataFrame]:
    """Issues, scores, summary and the worst twenty.

    The issues feed three outputs, so they are computed once and written to the
    shared folder.
    """
    issues = materialize(ql.all_issues(albums, tracks, tax, duplicates), "issues")
    return {"issues": issues, "scores": ql.scores(albums, issues), "summary": ql.issue_summary(issues),
            "top": ql.top_issues(issues)}


def run_report(albums: DataFrame, tracks: DataFrame | None, tax: Taxonomy, path: str, report_id: str, now: Column
               ) -> dict[str, DataFrame]:
    out = analyse(albums, tracks, tax)
    store.save_quality_report(out["scores"], out["issues"], report_id, now, path)
    return out
