"""How spread out a store's tokens are, within items and across them, with and without their mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.shared import keyed_hash, settled
from pairforge.functions.vectors import dot, l2_normalize, mean_vector, subtract


def off_diagonal(mean: Column, n: Column, squares: Column) -> Column:
    """Mean dot product over ordered pairs of different vectors, from their mean, number and sum of squared norms."""
    return (n * n * dot(mean, mean) - squares) / (n * (n - 1))


def _spread(vectors: DataFrame, name: str, by: list[str]) -> DataFrame:
    """(by, name): the mean cosine of different vectors `u` of unit length; groups of one have none."""
    m = mean_vector(vectors, "u", by).join(vectors.groupBy(*by).agg(F.sum(dot(F.col("u"), F.col("u"))).alias("sq")), by)
    return m.where("n > 1").select(*by, off_diagonal(F.col("mean"), F.col("n").cast("double"), F.col("sq")).alias(name))


def probed(tokens: DataFrame, probe: int, seed: int) -> DataFrame:
    """Tokens (side, item_id, pos, v) of at most `probe` items a side, the first by hash; that bound is the report's own."""
    items = tokens.select("side", "item_id").distinct().withColumn("h", keyed_hash(seed, F.col("item_id")))
    chosen = None
    for s in sorted(r.side for r in items.select("side").distinct().collect()):
        top = items.where(F.col("side") == s).orderBy("h", "item_id").limit(probe).select("side", "item_id")
        chosen = top if chosen is None else chosen.union(top)
    return tokens.join(F.broadcast(chosen), ["side", "item_id"]) if chosen is not None else tokens


def spread_report(tokens: DataFrame, probe: int = 256, each: int = 16, seed: int = 3) -> DataFrame:
    """(side, sequences, within, raw, to_mean, centered) of a sample of items.

    within: mean cosine of an item's tokens; raw, centered: of `each` tokens an item, pooled, before and after their mean is taken off;
    to_mean: mean absolute cosine to that mean.  Items of one token are left out.
    """
    some = settled(probed(tokens, probe, seed).withColumn("size", F.count("*").over(Window.partitionBy("side", "item_id"))).where("size > 1"), "probe")
    units = some.select("side", "item_id", l2_normalize(F.col("v")).alias("u"))
    within = _spread(units, "w", ["side", "item_id"]).groupBy("side").agg(F.count("*").alias("sequences"), F.avg("w").alias("within"))
    order = Window.partitionBy("side", "item_id").orderBy(keyed_hash(seed, F.col("item_id"), F.col("pos")), "pos")
    pool = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("side", "v", l2_normalize(F.col("v")).alias("u"))
    both = pool.join(F.broadcast(mean_vector(pool, "v", ["side"])), "side")
    to_mean = both.groupBy("side").agg(F.avg(F.abs(dot(F.col("u"), l2_normalize(F.col("mean"))))).alias("to_mean"))
    centered = both.select("side", l2_normalize(subtract(F.col("v"), F.col("mean"))).alias("u"))
    out = within.join(_spread(pool, "raw", ["side"]), "side").join(to_mean, "side").join(_spread(centered, "centered", ["side"]), "side")
    return out.select("side", "sequences", "within", "raw", "to_mean", "centered")
