"""What surrounds a token store: its dimension tables, its fingerprint, the checks before use, stale shards, token names, paths."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions.shared import positions
from pairforge.operators.identity import dense_ids

FINGERPRINT = "rows long, uids long, items long, captions long, digest string, settings string"


def dimensions(pairs: DataFrame) -> dict[str, DataFrame]:
    """items (item_id, protein, uid of its first row), row_map (row_idx, item_id), caption_ids (row_idx, text_gid), all by first appearance."""
    items = dense_ids(pairs, "protein", "row_idx", "item_id")
    uids = pairs.select(F.col("row_idx").alias("first"), "uid")
    texts = dense_ids(pairs, "text", "row_idx", "text_gid")
    return {
        "items": items.join(uids, "first").select("item_id", "protein", "uid"),
        "row_map": pairs.join(items, pairs.protein.eqNullSafe(items.protein)).select("row_idx", "item_id"),
        "caption_ids": pairs.join(texts, pairs.text.eqNullSafe(texts.text)).select("row_idx", "text_gid"),
    }


def fingerprint(pairs: DataFrame, settings: Mapping[str, object] | None = None) -> DataFrame:
    """One row that tells a corpus and the settings of its encoding from others; the order of rows does not matter."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("row_idx").cast("string"), "uid", "protein", "text")), 1, 15), 16, 10).cast("decimal(20,0)")
    return pairs.agg(
        F.count("*").alias("rows"),
        F.countDistinct("uid").alias("uids"),
        F.countDistinct("protein").alias("items"),
        F.countDistinct("text").alias("captions"),
        F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"),
        F.lit(json.dumps(dict(settings or {}), sort_keys=True)).alias("settings"),
    )


def merge(pairs: DataFrame, path: str, settings: Mapping[str, object] | None = None) -> None:
    """Writes the dimension tables and, when they are whole, the fingerprint below `path`."""
    for name, table in dimensions(pairs).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    fingerprint(pairs, settings).coalesce(1).write.mode("overwrite").json(f"{path}/fingerprint")


def faults(spark: SparkSession, path: str, pairs: DataFrame | None = None, settings: Mapping[str, object] | None = None, tokens: DataFrame | None = None) -> list[str]:
    """What speaks against using the store: another corpus or settings, rows without an item, items out of range, items without tokens."""
    saved = spark.read.schema(FINGERPRINT).json(f"{path}/fingerprint").first()
    out = []
    if pairs is not None:
        now = fingerprint(pairs, settings).first()
        out += [f"{k}: the store has {saved[k]}, the corpus {now[k]}" for k in now.asDict() if saved is None or saved[k] != now[k]]
    items, row_map = spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/row_map")
    n = items.agg(F.count("*").alias("n"), F.max("item_id").alias("most")).first()
    if n.n and n.most != n.n - 1:
        out.append(f"{n.n} items have ids up to {n.most}")
    m = row_map.agg(F.count("*").alias("n"), F.count_if(~F.col("item_id").between(0, n.n - 1)).alias("out")).first()
    if saved is not None and m.n != saved["rows"]:
        out.append(f"{m.n} rows are mapped, of {saved['rows']}")
    if m.out:
        out.append(f"{m.out} rows name items that do not exist")
    if tokens is not None and (lost := items.join(tokens.select("item_id").distinct(), "item_id", "left_anti").count()):
        out.append(f"{lost} items have no tokens")
    return out


def references(rows: DataFrame, key: str, items: DataFrame, item_id: str) -> DataFrame:
    """One row (rows, items, dangling, unused, nulls): how `key` of rows refers to `item_id` of items; counted by key, before any join of rows."""
    used = rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    there = items.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).alias("id")).agg(F.count("*").alias("m"))
    both = used.join(there, "id", "full")
    total = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0))
    return both.agg(total("n").alias("rows"), total("m").alias("items"), total("n", F.col("m").isNull() & F.col("id").isNotNull()).alias("dangling"), total("m", F.col("n").isNull()).alias("unused"), total("n", F.col("id").isNull()).alias("nulls"))


def require(spark: SparkSession, path: str, **checks) -> None:
    """Raises unless the store fits."""
    if found := faults(spark, path, **checks):
        raise ValueError(f"{path} is stale: " + "; ".join(found))


def clear_shards(spark: SparkSession, path: str, pattern: str = "shard-*") -> list[str]:
    """Deletes the files (never folders) directly below `path` that match, left by an earlier run with other shards; returns their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.globStatus(hadoop.Path(path, pattern)) or []:
        if status.isFile() and fs.delete(status.getPath(), False):
            gone.append(status.getPath().getName())
    return sorted(gone)


def shard_order(shards: DataFrame) -> DataFrame:
    """Shards (rank, world, start, length) by start, if they are one run's: equal worlds, each rank once, no gap and no overlap; raises otherwise."""
    before = F.coalesce(F.sum("length").over(Window.orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    placed = shards.withColumn("_off", F.col("start") != before)
    s = placed.agg(F.countDistinct("world").alias("worlds"), F.max("world").alias("world"), F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.count_if("_off").alias("off")).first()
    if s.worlds != 1 or s.n != s.world or s.ranks != s.world:
        raise ValueError(f"{s.n} shards of {s.worlds} runs do not make one of {s.world}")
    if s.off:
        raise ValueError(f"{s.off} of {s.n} shards do not begin where the one before ends")
    return shards.orderBy("start")


def token_names(tokens: DataFrame, vocabulary: DataFrame, token_id: str = "token_id") -> DataFrame:
    """tokens with a column `token`: the name in vocabulary (id, token), <id> where it has none."""
    names = vocabulary.select(F.col("id").alias(token_id), "token")
    return tokens.join(names, token_id, "left").withColumn("token", F.coalesce("token", F.concat(F.lit("<"), F.col(token_id).cast("string"), F.lit(">"))))


def with_labels(vocabulary: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """vocabulary (id, token) with the labels (label, and an order) that it lacks, after its last id in that order; repeated labels count once."""
    firsts = labels.groupBy("label").agg(F.min(order).alias("_first"))
    new = positions(firsts.join(vocabulary.select(F.col("token").alias("label")), "label", "left_anti"), ["_first", "label"], name="_k")
    last = vocabulary.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_last"))
    return vocabulary.select("id", "token").unionByName(new.crossJoin(F.broadcast(last)).select((F.col("_last") + 1 + F.col("_k")).alias("id"), F.col("label").alias("token")))


def resolve(defaults: Mapping[str, str], required: tuple[str, ...] = (), prefix: str = "PAIRFORGE_", environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings by name: the environment's PREFIX + NAME, else the default; raises for required ones that are empty."""
    env = os.environ if environment is None else environment
    out = {k: env.get(prefix + k.upper()) or v for k, v in defaults.items()}
    if missing := [prefix + k.upper() for k in required if not out.get(k)]:
        raise ValueError(f"not set: {', '.join(missing)}")
    return out
