"""The contract file: loads without a session, names agree, and queries equal their SQL at the smallest scale."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
from creditloom.plans.catalog import all_queries
from creditloom.sources.stand_ins import RAW
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NO_SQL = {"ml_1_stress_classifier", "ml_2_score_regressor", "ml_3_calibrator", "ml_6_model_decisions", "ml_7_importances"}


def test_names_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_every_query_has_sql_but_the_models():
    assert set(all_queries()) - set(entry_point.oracle_sql()) == NO_SQL


def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for r in RAW:
        con.execute(f"create view {r} as select * from '{FOLDER}/{r}.parquet'")
    return con


# The chain below covers the shared steps; tools/check.py compares all of them.
CHECKED = [
    "agg_6_bank_profile", "join_1_circular_pairs", "win_7_running_balance", "rec_2_tax_mismatch", "rec_3_anomalies", "wb_3_statement_figures", "wb_9_merged_facts",
    "txt_3_money_series", "txt_15_holders", "txt_22_page_findings", "prj_7_book_type", "prj_11_allowed_sources", "set_1_all_findings", "set_3_search_plan",
    "fea_1_credit_vector", "rul_1_policy_rules", "scr_7_decision_rows", "scr_9_five_cs", "exp_3_narratives", "gra_6_links", "swo_2_swot_points", "mem_1_risk_matrix",
    "top_1_vector_topk", "top_3_lexical_fallback", "src_12_upsert", "src_13_annual_tax_table", "agg_13_metrics", "ml_4_stratified_split",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    df = entry_point.queries()[name](spark, FOLDER)
    res = sql.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()], 12) == rows(names, res.fetchall(), 12)
