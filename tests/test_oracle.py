"""Every registered query against its DuckDB twin (the driver's correctness
gate), on the smallest scale factor; rows-only queries must simply run."""

import pytest

from mlqa.catalog import REGISTRY
from tools.oracle_check import compare, duck

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    fn, sql = REGISTRY[name]
    status, ns, nd, _, msg = compare(spark, con, name, fn, sql, SF_SMALL)
    assert status in ("ok", "rows-only"), f"{name}: {msg}"
    assert ns is not None and ns >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
