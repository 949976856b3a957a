"""Regression guards for the plan shapes the scale design relies on (PLANS.md)."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from conftest import SMOKE_DIR
from rostercast.plans.registry import load_all

# queries whose callables fit models eagerly (their returned frames are metric rows)
EAGER = {"l9_grid_search_reduced", "v8_learning_curve_reduced", "l11_model_search_reduced", "a_model_search_reduced", "b_holdout_evaluation",
         "b_holdout_frame_reduced", "b_holdout_summary_reduced",
         "c_monthly_roster", "c_monthly_roster_weekly", "l7_importance", "s5_model_roundtrip"}
# the only queries that output the exact distinct-customer count
WITH_DUTY = {"s1_daily_ops", "s1_daily_ops_segment", "a1_prepare", "a1_prepare_segment", "q1_preview",
             "q2_columns_report", "q5_distinct_report", "q6_describe", "q6_describe_segment", "g1_correlation",
             "v4_standardise", "r8_measure_panel"}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


DAILY = sorted(q for q in load_all()[0] if q not in EAGER)


@pytest.mark.parametrize("name", DAILY)
def test_orders_scanned_once_and_customers_joined_to_pairs(spark, name):
    plan = _plan(E.queries()[name](spark, SMOKE_DIR))
    assert len(re.findall(r"FileScan parquet \[o_", plan)) <= 1
    pair = re.search(r"Exchange hashpartitioning\(o_custkey#\d+L?, date", plan) is not None
    by_series = "FileScan parquet [c_" in plan
    # (customer, day) pairs come before the customer join, and for exact staff counts; else rows go straight to days
    assert not by_series or pair
    assert not pair or by_series or name in WITH_DUTY


def test_daily_scan_prunes_columns(spark):
    plan = _plan(E.queries()["s1_daily_ops"](spark, SMOKE_DIR))
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert set(c.split("#")[0] for c in scan.split(",")) == {"o_custkey", "o_orderstatus", "o_orderdate",
                                                             "o_orderpriority"}
