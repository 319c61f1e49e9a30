"""Every query against its SQL, on the small test data."""

import pytest

import __spark_entry__ as entry
from oracle import ROOT, compare, connect
from sparkloom.plans import catalog

SF = f"{ROOT}/sf0.01"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert frame.columns and frame.count() > 0
        return
    (got_names, got), (want_names, want) = compare(frame, duck, ORACLES[name])
    assert got_names == want_names
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
