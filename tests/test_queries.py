"""Every registered query against its SQL, on the smallest tables."""

import harness
import pytest

from dossierflow.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf, name):
    found = harness.ours(catalog.QUERIES[name](spark, sf))
    if name in catalog.ORACLES:
        assert found == harness.oracle(sf, catalog.ORACLES[name])
    else:
        assert found[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
