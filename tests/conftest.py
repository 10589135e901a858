import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    s = local_session("*", app="quire-tests")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect small test results as tuples (test helper only)."""
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
