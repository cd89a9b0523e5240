"""Every core query against its SQL, over whole tables."""

import os

import pytest

from mossbrook.plans import registry
from tests.oracle import DIR, duck, table

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.ORACLES:
        assert table(got) == table(duck(registry.ORACLES[name]))
    else:
        assert len(got.columns) > 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES
