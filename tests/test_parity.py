"""Every core query against its SQL twin over the smallest tables."""

import pytest
from parity import same

from tidewell.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    same(registry.queries()[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() >= 0
