"""The registered queries: SQL where there is some, whole tables, native plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfmark.llm.queries import QUERIES
from suite.check import TABLES, compare
from tests.conftest import SF


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline", "quoted"}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(spark, con, *QUERIES[name], SF) is None


@pytest.mark.parametrize("name,table", [("op1_quality", "documents"), ("op3_simhash", "documents"), ("op7_pii", "documents"),
                                        ("op8_url_filter", "pages"), ("op9_toxicity", "documents"),
                                        ("op10_secrets", "documents"), ("op11_language", "documents")])
def test_a_row_for_every_row(spark, name, table):
    assert QUERIES[name][0](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op5_quality_rules", "op6_quote_chat", "quoted_conversations"])
def test_native_plans(spark, name):
    plan = QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_rule_table_gives_one_projection(spark):
    from shelfmark.llm.quality_rules import RULES, Rule, compile_rules
    rows = spark.createDataFrame([(10, 0, 0), (10, 9, 0), (10, 0, 5)], "n_words long, n_symbols long, n_lines long")
    rules = (Rule("symbols", "n_symbols / n_words", None, 0.3), Rule("length", "n_words / n_lines", None, 1.0))
    assert [r[0] for r in rows.select(compile_rules(rules)).collect()] == [True, False, False]
    assert len({r.name for r in RULES}) == len(RULES)
