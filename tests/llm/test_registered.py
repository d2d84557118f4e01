"""The registered corpus queries: names, and check SQL where there is one."""
from check import compare, connect

import __spark_entry__ as entry
from peakgrid.llm.queries import ORACLE

FOLDER = "/root/testdata/sf0.01"


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_against_sql(spark):
    for name, sql in ORACLE.items():
        err, n = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), sql)
        assert err is None and n, err
