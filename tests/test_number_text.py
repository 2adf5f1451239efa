import duckdb
from pyspark.sql import functions as F

from pairforge.functions.shared import number_text


def test_doubles_as_text(spark):
    """Small recalls show as in SQL: 0.000975, not 9.75E-4; a hundred-thousandth as 1e-05."""
    values = [0.0, 1.0, 0.5, 0.000975, 0.0001, 0.000123, 0.001, 9.9e-05, 1e-05, 1e-06, 0.123456, -0.0005, 12345678.5, 1e7, 123456789012345.0, 1e15, 1e16, 1.5e20, 1e-300]
    got = [r.t for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", number_text(F.col("v")).alias("t")).orderBy("k").collect()]
    con = duckdb.connect()
    want = [con.sql(f"SELECT CAST({v!r}::DOUBLE AS VARCHAR)").limit(1).fetchall()[0][0] for v in values]
    assert got == want
