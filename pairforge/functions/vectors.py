"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    # the norm as an array beside the vector, so that it is worked out once and not for each element
    return F.zip_with(v, F.array_repeat(F.greatest(norm(v), F.lit(eps)), F.size(v)), lambda x, n: x / n)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean_vector(df: DataFrame, v: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, mean, n): element-wise mean.  Vectors are summed as they are, in partial aggregates of one vector a task and key; null and empty ones do not count."""
    some = df.where(F.size(v) > 0).select(*keys, array_to_vector(F.col(v).cast("array<double>")).alias("_v"))
    return some.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean"), F.count("*").alias("n")).where("n > 0")
