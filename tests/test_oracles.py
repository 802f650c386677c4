"""Every query with an oracle must return the oracle's rows."""

import pytest

from compare import ROOT, compare, oracle_connection
from lectern.queries import ORACLES, QUERIES

FOLDER = ROOT + "0.001"
#: Ten readers leave no overlap of exposures, so these are empty at this scale and checked at a larger one.
EMPTY_HERE = {"f10_exposure_overlap", "x05_exposure_balanced_splits"}


@pytest.fixture(scope="module")
def con():
    connection = oracle_connection(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    status, detail = compare(spark, con, name, FOLDER)
    assert status == "ok" or (status == "EMPTY" and name in EMPTY_HERE), f"{status}: {detail}"


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
