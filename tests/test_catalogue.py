"""Every registered query with SQL against DuckDB, and the plans of a few."""

import duckdb
import numpy as np
import pytest

from weftline.plans import catalogue_answers, catalogue_dialogue, catalogue_eval, catalogue_ops, catalogue_runs, catalogue_search, catalogue_text

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue_search.SQL | catalogue_text.SQL | catalogue_ops.SQL | catalogue_eval.SQL | catalogue_dialogue.SQL | catalogue_answers.SQL | catalogue_runs.SQL
QUERIES = catalogue_search.QUERIES | catalogue_text.QUERIES | catalogue_ops.QUERIES | catalogue_eval.QUERIES | catalogue_dialogue.QUERIES | catalogue_answers.QUERIES | catalogue_runs.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df):
    def value(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.6f}" if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue_ops.feedback_page(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    plan = catalogue_ops.pricing_summary(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan


def test_relevance_lists_no_pairs(spark):
    for query in (catalogue_search.retrieval_metrics, catalogue_search.rank_debug):
        plan = query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "id#" in plan and not [line for line in plan.splitlines() if "Join Inner, (label" in line and "relevant" not in plan]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
