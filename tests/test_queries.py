"""Every registered query of the library against its SQL."""

import pytest
from conftest import SF
from helpers import rows_of, sql_rows

from passages import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = rows_of(catalog.queries()[name](spark, SF))
    if name in catalog.oracle_sql():
        assert found == sql_rows(duck, catalog.oracle_sql()[name])
    else:
        assert found[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
