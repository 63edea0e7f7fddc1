"""Every registered query with a SQL oracle equals DuckDB on sf0.001."""

import importlib.util
import os
import sys

import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
spec = importlib.util.spec_from_file_location(
    "oracle_check", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "oracle_check.py"))
oc = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oc)

from regula.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402

load_all()


@pytest.fixture(scope="module")
def con():
    return oc.duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert oc.type_diff(sdf, cur) == {}
    assert oc.rows_of(sdf.columns, srows, 6) == oc.rows_of(dcols, drows, 6)
