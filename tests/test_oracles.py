import pytest

import __spark_entry__ as contract
from ensspark.plans import catalog
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF_DIR) > 0


def test_the_contract_registers_them_all():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
