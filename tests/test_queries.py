"""Every registered query against its SQL in a second engine."""

import pytest
from conftest import same_rows

from sievework.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["source", "lane", "n"]
