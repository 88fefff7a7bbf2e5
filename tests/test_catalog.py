import os

import pytest

import oracle
from keelson.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLES:
        assert df.columns and df.count() >= 0
        return
    assert oracle.difference(df, duck, ORACLES[name]) is None


def test_every_query_has_sql():
    assert sorted(set(QUERIES) - set(ORACLES)) == []
