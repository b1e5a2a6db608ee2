"""The queries that SQL can express equal their twins on whole tables."""

import pytest
from compare import connect, differences

from caudal.llm.registered import QUERIES
from caudal.llm.twins import SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    made = connect(SF)
    for name in ("documents", "pages", "benchmark"):
        made.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []
