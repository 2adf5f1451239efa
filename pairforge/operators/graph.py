"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.shared import settled

ONE_TASK = 1 << 20  # edges, 16 MB, that one task joins at once


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (a, b), node ids and the smallest id that each reaches through them."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        ru, rv = root[u], root[v]
        if (same := ru == rv).all():
            return ids, ids[root]
        u, v = u[~same], v[~same]
        low, high = np.minimum(ru, rv)[~same], np.maximum(ru, rv)[~same]
        np.minimum.at(root, high, low)
        while not np.array_equal(nxt := root[root], root):
            root = nxt


def _to_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = roots = np.zeros(0, np.int64)
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        ids, roots = forest(np.concatenate([ids, a]), np.concatenate([roots, b]))
    keep = ids != roots
    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(roots[keep])], names=["node", "root"])


def components(edges: DataFrame, a: str, b: str, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): every node that has a smaller one in its component, and the smallest.

    Each partition first reduces its edges to a forest.  Where at most `one_task` edges are left, one task makes them one forest.  Else large-star and small-star rounds run until every node
    has one root and no root has another; the forests keep the rounds few.  Each round is written to the shared
    folder, so a lost executor costs one round, and nothing but two counts comes to the driver.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root")
    now = settled(now.mapInArrow(_to_forest, "node long, root long"), "components")
    if now.count() <= one_task:
        return settled(now.coalesce(1).mapInArrow(_to_forest, "node long, root long"), "components")
    while True:
        many = now.groupBy("node").count().where("count > 1").limit(1).count()
        if not many and not now.join(now.select(F.col("node").alias("root")), "root", "left_semi").limit(1).count():
            return now
        both = now.union(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = large.where("node <> root").distinct()
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        joined = large.join(least, "node")
        small = joined.select("node", F.col("low").alias("root")).union(joined.select(F.col("root").alias("node"), F.col("low").alias("root")))
        now = settled(small.where("node <> root").distinct().mapInArrow(_to_forest, "node long, root long"), "components")
