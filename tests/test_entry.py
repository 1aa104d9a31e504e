import os

import pytest

import __spark_entry__ as entry

SMOKE = "/root/testdata/sf0.001"


def test_registers():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "p2_found" in q


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no test tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["model", "clips", "coverage", "empty_rate", "loop_rate", "armenian_pct", "vs_anchor"]
    assert df.count() >= 0
