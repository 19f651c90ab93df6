"""Every query against its SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare, connect
from workload.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    verdict, rows, _ = compare(spark, con, SF_DIR, name)
    assert verdict == "ok"
    assert rows > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "deal_number"
    numbers = sorted(r[0] for r in df.select("deal_number").collect())
    assert numbers == list(range(1, len(numbers) + 1)) and numbers
