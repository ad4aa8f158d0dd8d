"""Every query of the ten problems against its SQL where it has one."""

import pytest
from oracle import same

from pathloom.llm import queries, sql

QUERIES, SQL = queries.queries(), sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()
