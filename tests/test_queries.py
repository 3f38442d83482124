"""Every registered query against its SQL on the smallest tables."""

import pytest

from hindsight.plans import load_all
from hindsight.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: Queries that the smallest tables leave without rows.
EMPTY = set()
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, *_ = compare(spark, con, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem == ("no rows" if name in EMPTY else "")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
