"""Registered queries at the smallest scale against their SQL (a selection; tools/check.py runs all)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, compare

PATH = "/root/testdata/sf0.001"
CHOSEN = ["flt1_filter_suffixes", "flt2_exists_and_not_exists", "src1_bronze_silver_gold_revenue", "jon9_point_in_time", "jon12_event_label", "mrg1_upsert", "cdc3_apply_changes",
          "agg12_ohlcv_bars", "agg41_weighted_median", "win5_technical_indicators", "win21_latency_percentiles", "dq9_record_rules", "dq12_score_moving_average", "dq20_ks_drift",
          "ts1_resample", "gra6_connected_components", "rec1_item_recommendations", "jon13_cooccurrence", "sch1_exact_knn", "sch3_bm25", "fea2_online_view", "ml9_auc",
          "aml1_velocity", "rsk2_value_at_risk", "cep3_money_laundering", "sla2_failover", "str2_tumbling_windows", "cep_stream_account_takeover"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{PATH}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(entry.queries()[name](spark, PATH), con.sql(entry.oracle_sql()[name]))
    assert ok, note


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(PATH):
        assert entry.entry(spark).count() > 0
