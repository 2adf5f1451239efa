"""Prompts without end: every epoch is another order of all rows, drawn by a keyed permutation of their numbers.

The permutation is a function of (seed, epoch, place) alone, so an epoch needs no shuffle and no memory, ranks share it out by their places, and a
stream that starts again goes on where its checkpoint stands.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.shared import positions

ROUNDS = 6


def _keys(seed: int, epoch: int) -> np.ndarray:
    raw = hashlib.blake2b(f"{seed}|{epoch}".encode(), digest_size=8 * ROUNDS).digest()
    return np.frombuffer(raw, "<u8")


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(places: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The row at each place of the epoch's order: a permutation of 0 .. n-1.

    A balanced Feistel network permutes the least square of a power of two that holds n; what it moves beyond n is moved on until it comes back.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed, epoch)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_scramble(right + key) & mask)
        return (left << half) | right

    out = once(np.asarray(places).astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= n)):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def dealt(ticks: DataFrame, n: int, world: int = 1, seed: int = 0) -> DataFrame:
    """(epoch, place, rank, row_idx) of a column `value` of numbers from 0 on; n rows an epoch, its places shared out over the ranks in turn."""

    @F.pandas_udf("long")
    def row(epoch: pd.Series, place: pd.Series) -> pd.Series:
        out = np.zeros(len(epoch), np.int64)
        e, p = epoch.to_numpy(), place.to_numpy()
        for one in np.unique(e):
            out[e == one] = permuted(p[e == one], n, seed, int(one))
        return pd.Series(out)

    epoch, place = F.floor(F.col("value") / n).cast("long"), F.pmod("value", F.lit(n)).cast("long")
    at = ticks.select(epoch.alias("epoch"), place.alias("place"))
    rank: Column = F.pmod("place", F.lit(world))
    return at.select("epoch", "place", rank.alias("rank"), row("epoch", "place").alias("row_idx"))


def epochs(spark: SparkSession, n: int, count: int, world: int = 1, seed: int = 0) -> DataFrame:
    """The first `count` epochs as a table."""
    return dealt(spark.range(n * count).withColumnRenamed("id", "value"), n, world, seed)


def stream(spark: SparkSession, n: int, a_batch: int, world: int = 1, rank: int | None = None, seed: int = 0) -> DataFrame:
    """Prompts without end, `a_batch` of all ranks a micro-batch; of one rank where it is given.  A checkpoint resumes them exactly."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", a_batch).load()
    out = dealt(ticks, n, world, seed)
    return out if rank is None else out.where(F.col("rank") == rank)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with row_idx, from 0 in `order`."""
    return positions(rows, [order], name="row_idx")
