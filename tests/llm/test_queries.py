"""Queries of this subpackage against their SQL, and by their contracts where SQL has no form."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from sparkloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert queries.QUERIES.keys() <= names.keys()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    (got_names, got), (want_names, want) = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert got_names == want_names
    assert got == want
