"""Every query against its SQL, on the smallest tables."""

import pytest

from lexloom.plans import registry
from tests.conftest import canonical


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(registry.ORACLE[name]).df()
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert (rows[0]["doc_id"], rows[0]["head"], rows[0]["score"]) == (1, "estion", 1.0)
    assert set(entry.oracle_sql()) <= set(entry.queries())
