"""Every registered query equals its SQL twin on whole tables."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from caudal.plans.registered import QUERIES
from caudal.plans.twins import SQL

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["fecha", "pais", "segmento", "n_tx", "n_clientes", "monto_total"]
    assert df.limit(1).count() == 1
