"""Every query of the reference's operators against its SQL on the small tables."""

import pytest

from lectern.plans import ORACLES, QUERIES
from tests.compare import connect, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf_dir, con, key):
    got = QUERIES[key](spark, sf_dir).toPandas()
    if key in ORACLES:
        want = con.execute(ORACLES[key]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
