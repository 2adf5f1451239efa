"""Splits, pools and shards, all from keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.shared import keyed_hash, positions


def cut_points(n: Column, ratios: tuple[float, float]) -> tuple[Column, Column]:
    """Ends of the first two parts of n, each rounded half to even."""
    one = F.bround(n * F.lit(ratios[0]), 0)
    return one, one + F.bround(n * F.lit(ratios[1]), 0)


def named(position: Column, n: Column, ratios: tuple[float, float]) -> Column:
    one, two = cut_points(n, ratios)
    return F.when(position < one, "train").when(position < two, "val").otherwise("test")


def split(df: DataFrame, key: str, seed: int, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """(key, ord, split) of the distinct keys in hash order."""
    keys = df.select(key).distinct().withColumn("_h", keyed_hash(seed, F.col(key)))
    placed = positions(keys, ["_h", key], name="ord")
    n = placed.agg(F.count("*").alias("_n"))
    return placed.crossJoin(F.broadcast(n)).select(key, "ord", named(F.col("ord"), F.col("_n"), ratios).alias("split"))


def split_by_group(df: DataFrame, row: str, group: str, seed: int, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """(row, group, split): groups stay whole."""
    return df.select(row, group).join(split(df, group, seed, ratios).select(group, "split"), group).select(row, group, "split")


def hash_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The n rows with the least hashes, by distributed top-n."""
    return df.withColumn("_h", keyed_hash(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def shard_range(n: Column, world: int, rank: Column) -> tuple[Column, Column]:
    """Start and length of a contiguous balanced shard; the first n mod world get one more."""
    base, extra = F.floor(n / world), n % world
    return (rank * base + F.least(rank, extra)).cast("long"), (base + F.when(rank < extra, 1).otherwise(0)).cast("long")


def tiling(shards: DataFrame, total: Column) -> DataFrame:
    """One row: whether the shards (start, length) tile [0, total) without gaps."""
    w = Window.orderBy("start")
    ends = shards.withColumn("_end", F.col("start") + F.col("length"))
    steps = ends.withColumn("_prev", F.lag("_end", 1, 0).over(w))
    return steps.agg((F.min(F.col("_prev") == F.col("start")) & (F.max("_end") == F.max(total))).alias("tiles"), F.count("*").alias("shards"), F.max("_end").alias("covered"))
