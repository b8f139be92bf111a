import os

import pytest

import __spark_entry__ as entry


def test_queries_and_sql_go_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
