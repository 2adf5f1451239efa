"""Identities of a pair table: dense ids, first rows, components over several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.shared import positions, settled
from pairforge.operators.graph import components


def dense_ids(df: DataFrame, key: str, order: str, name: str = "gid") -> DataFrame:
    """(key, first, gid): ids by first appearance."""
    firsts = df.groupBy(key).agg(F.min(order).alias("first"))
    return positions(firsts, ["first"], name=name)


def first_rows(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The values of the first row of each key: one partial aggregate, no window."""
    best = df.groupBy(key).agg(F.min_by(F.struct(order, *values), order).alias("_row"))
    return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in (order, *values)))


def connected_components(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """(row, root): rows joined by any equal key; root is the smallest row.  Null keys join nothing.

    Each row is linked to the first row of each of its keys, which gives a number of edges that is linear in the rows.
    """
    keyed = F.array(*(F.concat(F.lit(f"{k}|"), F.col(k).cast("string")) for k in keys))
    links = settled(df.select(F.col(row).cast("long").alias("a"), F.explode(keyed).alias("_k")).where("_k is not null"))
    firsts = links.groupBy("_k").agg(F.min("a").alias("b"))
    roots = components(links.join(firsts, "_k").where("a <> b"), "a", "b").withColumnRenamed("node", row)
    return df.select(row).join(roots, row, "left").select(row, F.coalesce("root", row).alias("root"))
