"""Every evidence query with SQL equals DuckDB's result; those without it give rows."""

import pytest
from oracle import connect, differences

from assaylake.plans import registry

SF = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    if name in SQL:
        assert differences(df, db, SQL[name]) is None
    else:
        assert df.count() > 0
