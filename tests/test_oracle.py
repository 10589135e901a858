"""Every registered query against its DuckDB twin on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import digest, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) >= 0
        return
    want = con.execute(sql).df()
    assert digest(got) == digest(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 1
    assert set(df.columns) == {"total_processed", "by_category", "top_tags", "highlights"}
