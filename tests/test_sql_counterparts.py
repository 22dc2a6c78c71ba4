"""Every registered query against its SQL text on the smallest test tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import compare as cmp  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return cmp.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    rows, problem = cmp.compare(spark, con, entry_module.queries()[name], ORACLES.get(name), SF_DIR)
    assert problem is None
    if name not in ORACLES:  # no SQL: at least the query has found something to report
        assert rows > 0


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
