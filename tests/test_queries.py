"""Every core query with a SQL counterpart agrees with it on the smallest tables."""

import pytest

from notegraph.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
