import pytest
from compare import connect, duck_rows, spark_rows

from pairforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    cols, rows = spark_rows(QUERIES[name](spark, SF))
    want_cols, want = duck_rows(connect(SF), ORACLES[name])
    assert cols == want_cols and rows == want
