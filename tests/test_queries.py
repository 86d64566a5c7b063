"""Every named query against its SQL, on the smallest tables; a query with two names is run once."""

import pytest
from conftest import DATA

from scenequery import catalogue

NAMES = {query: name for name, query in sorted(catalogue.QUERIES.items(), reverse=True)}


def test_second_names_have_the_same_sql():
    assert all(catalogue.ORACLE_SQL[name] == catalogue.ORACLE_SQL[NAMES[query]] for name, query in catalogue.QUERIES.items() if name in catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(NAMES.values()))
def test_query_equals_sql(spark, same, name):
    result = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.ORACLE_SQL:
        same(result, catalogue.ORACLE_SQL[name])
    else:
        assert result.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
