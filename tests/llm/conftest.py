import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return brute.frame(spark, brute.edge_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return brute.frame(spark, [])
