"""Every query of the library against its DuckDB twin on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

from assayer.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_duckdb(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), duck, catalog.ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
