"""Every registered query of the field engine against its SQL, on the smallest tables."""

import pytest

import __spark_entry__
from fieldloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, same_rows, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        same_rows(got, duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
