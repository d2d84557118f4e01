"""Every registered query against its check SQL on the smallest tables."""
import pytest
from check import compare, connect

import __spark_entry__ as entry
from peakgrid.plans import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLE
    err, _ = compare(QUERIES[name](spark, FOLDER), con, ORACLE[name])
    assert err is None, err


def test_entry(spark):
    assert "peak_no" in entry.entry(spark).columns
