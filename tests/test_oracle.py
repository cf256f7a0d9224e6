"""Every registered query against its SQL, over whole tables."""

import oracle
import pytest

import __spark_entry__ as contract
from catalogq.workloads import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_contract_has_all_queries():
    assert set(ORACLES) <= set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert oracle.difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
