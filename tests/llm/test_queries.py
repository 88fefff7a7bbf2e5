import os

import pytest

import oracle
from keelson.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, DATA), oracle.connect(DATA), ORACLES[name]) is None
