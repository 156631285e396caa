"""Every registered query of the library: against its SQL where there is some, else that it runs and has a stable schema."""

import pytest
from oracle import connect, same_rows

from millrace.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    if name in catalog.oracle_sql():
        same_rows(df, connect(sf), catalog.oracle_sql()[name])
    else:
        rows = df.collect()
        assert df.columns and len(rows) > 0


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
