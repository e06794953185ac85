"""Registered queries against their SQL on the smallest tables, and the shape of their plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from suite import registered
from suite.check import TABLES, compare
from tests.conftest import SF

QUERIES = {name: fn for name, (fn, _) in registered().items()}
ORACLE = {name: sql for name, (_, sql) in registered().items() if sql is not None}
STREAMS = [n for n in QUERIES if n.startswith("stream_")]
PYTHON = {"match_sequence_metric", "name_percentages"}
# a handful per family; ``python -m suite.check`` compares all of them
SAMPLE = ["genre_distribution", "album_totals", "registry_merge", "normalize_category", "normalize_list", "best_match",
          "tiered_search", "aggregate_votes", "duplicate_pairs", "artist_profiles", "genre_issues", "track_issues",
          "batch_decisions", "job_summary", "changed_fields", "album_status", "page_by_artist", "stream_job_progress"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLE[name], SF) is None


def test_only_python_metric_lacks_sql():
    assert set(QUERIES) - set(ORACLE) == PYTHON


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON)
    if name != "era_lookup":  # the era table has seven rows and is a constant
        assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
