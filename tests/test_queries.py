import pytest

from sqlcheck import same
from strandloom.plans import catalog, queries

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("query", queries.ALL, ids=lambda f: f.__name__)
def test_query(spark, query):
    df = query(spark, FOLDER)
    if query.__name__ in SQL:
        same(df, SQL[query.__name__], FOLDER)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
