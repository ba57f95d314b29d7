import pytest
from oracle import agree

import __spark_entry__ as entry
from tessera import queries as core


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, sf, name):
    agree(spark, sf, core.queries()[name], core.oracle_sql()[name])


def test_entry_and_registration(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
