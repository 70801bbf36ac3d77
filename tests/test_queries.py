import duckdb
import pytest

import __spark_entry__ as contract
import check
from schemaweft.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [
    "base_table_generate",
    "catalog_metadata",
    "benchmark_pair_load",
    "legacy_abbreviate",
    "legacy_table",
    "legacy_lineage",
    "legacy_merge_fields",
    "match_trigram_topk",
    "match_sequence_ratio",
    "match_cupid",
    "match_flooding",
    "eval_report",
    "audit_checks",
    "audit_files",
    "stability_shuffle_lost",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    result = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert check._rows(df.columns, df.collect()) == check._rows(columns, result.fetchall())


def test_entry(spark):
    assert {r.matcher for r in contract.entry(spark).collect()} == {"exact", "normalized", "trigram"}


@pytest.mark.parametrize("name", ["match_trigram_topk", "match_cupid", "eval_report", "audit_summary", "audit_files", "legacy_lineage"])
def test_no_cross_join_in_plans(spark, name):
    df = contract.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
