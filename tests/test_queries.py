import pytest

import __spark_entry__ as entry
from compare import connect, duck_rows, spark_rows
from pairforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    cols, rows = spark_rows(catalog.QUERIES[name](spark, SF))
    assert rows
    if name in catalog.ORACLES:
        want_cols, want = duck_rows(duck, catalog.ORACLES[name])
        assert cols == want_cols
        assert len(rows) == len(want)
        wrong = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
        assert not wrong, wrong[:3]


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
