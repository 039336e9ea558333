"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tools.check_queries import compare, duck
from tracelight.plans import all_queries

SF = os.environ.get("TRACELIGHT_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, con, name):
    q = all_queries()[name]
    ok, detail, _ = compare(spark, con, name, q.run, q.sql, SF)
    assert ok is not False, detail


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 85
