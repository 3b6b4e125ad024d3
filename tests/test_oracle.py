"""Every registered query against its DuckDB oracle (or rows-only) at sf0.001."""

import pytest

from tests.conftest import SMOKE
from tests.oracle_check import compare


def _names():
    from tabloom.plans import registry as r
    r.load_all()
    return sorted(r.QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, registry, duck, name):
    fn = registry.QUERIES[name]
    sql = registry.ORACLES.get(name)
    if sql is None:
        assert fn(spark, SMOKE).count() >= 0
        return
    ok, _, _, msg = compare(spark, duck, name, fn, sql, SMOKE)
    assert ok, msg


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
