import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import connect, rows_of, sql_rows  # noqa: E402

from textloom.plans import catalog, corpus, scripts  # noqa: E402, F401


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, data, con):
    columns, rows = rows_of(catalog.QUERIES[name](spark, data))
    if name in catalog.ORACLES:
        assert rows == sql_rows(con, catalog.ORACLES[name], columns)
    else:
        assert columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
