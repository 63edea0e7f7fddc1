"""Plan checks: SQL-expressible queries stay in the JVM, filters reach the
scan, and the driver contract is well formed."""

import importlib.util
import os

import pytest

from conftest import SF_SMALL
from regula.plans.registry import ORACLES, QUERIES, load_all

load_all()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["R3_sponsor_performance_top20", "P1_P2_risk_scores", "B3_column_profile_orders",
                                 "T2_monthly_series", "M2_M3_approval_features", "Z3_mann_whitney_priority_faster"])
def test_no_python_in_sql_queries(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_filters_pushed_to_scan(spark):
    plan = _plan(QUERIES["T11_yearly_growth_filtered"](spark, SF_SMALL))
    assert "EqualTo(o_orderstatus,F)" in plan


def test_driver_contract(spark):
    spec = importlib.util.spec_from_file_location("entry_mod", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    assert set(ORACLES) <= set(o)
