import os

import pytest

import __spark_entry__
from oracle import SF, files, same_rows
from tallygrid.plans import catalog

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    same_rows(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], files())


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
