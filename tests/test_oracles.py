"""Every registered query against DuckDB; those without SQL must run and return rows."""

import pytest

from pageweave.plans import chain, fitting, interiors, registry, runtime, typesetting  # noqa: F401
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    if name in registry.oracle_sql():
        same(spark, registry.queries()[name], registry.oracle_sql()[name])
    else:
        assert registry.queries()[name](spark, SF).count() > 0
