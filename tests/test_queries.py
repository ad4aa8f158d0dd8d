"""Every query of the core against its SQL, and the driver's contract."""

import os
import subprocess
import sys

import pytest
from oracle import same

from pathloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["token", "id", "freq"] and df.count() > 3


def test_core_remains_without_a_package_of_the_rest():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'vocab' in q and set(s) <= set(q)"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=here, check=True)
