"""Command line: python -m pairforge.cli COMMAND ...

  encode CSV STORE          pair CSV to a token store of both sides (stand-in encoder, or --encoder module:factory)
  merge CSV DIR             dimension tables and fingerprint of the corpus; --check tells whether DIR still fits
  means STORE               mean token vector of each side
  splits CSV OUT            group-wise splits; --check tells whether OUT still fits, --force rebuilds it
  decoys CSV OUT            decoy plan, texts with their keep flags, and coverage by label
  evaluate STORE [CSV]      retrieval recall; with the CSV, pairs of one uid count as relevant too, both ways, with ranks and precision
  inspect CSV STORE UID...  the first row of each uid and its best token alignments
  export STORE OUT [DIR]    pooled vectors of both sides, with the uids and the rows' items of the merged DIR where it is given
  diagnose STORE            how spread out the tokens are, raw and without their mean
  roundtrip RECORDS OUT     generated targets against their sources: metrics, pairs and, with --proteins, sequences
  generated CANDIDATES OUT  the best candidate of each accession and replicate as CSV
  pack STORE OUT            the token store as packed files of each side (--kind bf16 or f32), read by byte ranges
  live CSV OUT              both sides encoded straight into packed files, --world ranges one after the other (or --rank alone); ranges that are
                            there are passed over, and when all are they are merged; with --weights through the model's projection heads
  score RECORDS OUT         round-trip records with pseudo-perplexities of the generated and true targets (--scorer module:factory, --passes)
  ablate LOSSES             token losses (condition, seq, loss) with, with another row's and without a memory: what its presence and content gain
  settings                  the paths that the environment names (PAIRFORGE_CSV, _STORE, _MERGED, _WEIGHTS), and whether they are there

A path written @csv, @store, @merged or @weights stands for the one that the environment names.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.vectors import dot, l2_normalize, mean_vector
from pairforge.operators import ablation, captions, encode, geometry, identity, ranking, roundtrip, splits, stores, weights
from pairforge.sources import packed, readers, sinks

SIDES = ("protein", "text")


def _factory(name: str | None):
    if not name:
        return encode.hash_encoder
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _nested(store: DataFrame, side: str) -> DataFrame:
    """(item_id, tokens): normalised tokens of one side in order."""
    rows = store.where(F.col("modality") == side).select("item_id", "pos", l2_normalize(F.col("v").cast("array<double>")).alias("v"))
    return rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("tokens"))


def encode_csv(spark: SparkSession, csv: str, store: str, encoder: str | None = None, subset: int = 0) -> None:
    pairs = readers.read_pairs(spark, csv, subset=subset)
    for side in SIDES:
        tokens = encode.encode(pairs.select(F.col("row_idx").alias("item_id"), side), side, _factory(encoder))
        sinks.write_tokens(tokens.select("item_id", F.posexplode("tokens").alias("pos", "v")), store, side)


def means(spark: SparkSession, store: str) -> DataFrame:
    return mean_vector(spark.read.parquet(store).withColumn("v", F.col("v").cast("array<double>")), "v", ["modality"])


def pack(spark: SparkSession, store: str, out: str, kind: str = "bf16") -> None:
    """A side's items count from 0 to the store's last; those without tokens have none."""
    rows = spark.read.parquet(store)
    last = rows.agg(F.max("item_id")).first()[0]
    for side in SIDES:
        nested = rows.where(F.col("modality") == side).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("tokens"))
        every = spark.range(0 if last is None else last + 1).withColumnRenamed("id", "item_id")
        packed.write(every.join(nested, "item_id", "left"), f"{out}/{side}", kind)


def live(spark: SparkSession, csv: str, out: str, world: int, rank: int | None = None, encoder: str | None = None, model: str | None = None, kind: str = "bf16", subset: int = 0) -> list[str]:
    """Encodes each side of the CSV into packed files, a range of rows after the other; returns the sides that are whole.

    A run that broke off is started again with the same `world` and writes what is missing; after one with another world the folders are to be cleared.
    """
    pairs = readers.read_pairs(spark, csv, subset=subset)
    n, done = pairs.count(), []
    for side in SIDES:
        path = f"{out}/{side}"
        for k in packed.missing(path, world):
            if rank is None or k == rank:
                mine = pairs.select(F.col("row_idx").alias("item_id"), side).where(packed.of_rank(n, k, world))
                rows = encode.encode(mine, side, _factory(encoder))
                if model:
                    rows = weights.project(rows, "tokens", model, f"{side}_proj").drop("tokens").withColumnRenamed("z", "tokens")
                packed.write(rows.select("item_id", "tokens"), path, kind, (k, world))
        if not packed.missing(path, world):
            packed.merge(spark, path)
            done.append(side)
    return done


def score(spark: SparkSession, records: str, out: str, scorer: str | None = None, passes: int = 8) -> None:
    """Adds pppl_gen and pppl_true, letters being the tokens; not a number where there are none."""
    rows = spark.read.parquet(records)
    factory = _factory(scorer) if scorer else lambda: encode.counting_scorer(26)
    for name, target in (("pppl_gen", "gen_target"), ("pppl_true", "true_target")):
        letters = rows.select("row_idx", F.filter(F.split(F.upper(target), ""), lambda x: x.rlike("[A-Z]")).alias("t"))
        found = encode.pseudo_perplexity(letters, "row_idx", "t", factory, passes).select("row_idx", F.col("pppl").alias(name))
        rows = rows.drop(name).join(found, "row_idx", "left")
    rows.write.mode("overwrite").parquet(out)


PATHS = ("csv", "store", "merged", "weights")


def settings() -> dict[str, str]:
    return stores.resolve(dict.fromkeys(PATHS, ""))


def named(path: str) -> str:
    """A path as given, or the one that the environment names for @name."""
    return stores.resolve({path[1:]: ""}, (path[1:],))[path[1:]] if path.startswith("@") else path


def group_splits(spark: SparkSession, csv: str, seed: int, ratios: tuple[float, float]) -> DataFrame:
    pairs = readers.read_pairs(spark, csv).withColumn("h", F.md5("text"))
    return splits.split_by_group(identity.connected_components(pairs, "row_idx", ["uid", "h"]), "row_idx", "root", seed, ratios)


def split_header(spark: SparkSession, csv: str, seed: int, ratios: tuple[float, float]) -> dict:
    s = group_splits(spark, csv, seed, ratios)
    n = s.agg(F.count("*").alias("n"), F.countDistinct("root").alias("g")).first()
    return {"n": n.n, "seed": seed, "ratios": list(ratios), "n_groups": n.g}


def fits(saved: dict, now: dict) -> bool:
    same = all(abs(a - b) <= 1e-9 for a, b in zip(saved.get("ratios", []), now["ratios"], strict=False)) and len(saved.get("ratios", [])) == len(now["ratios"])
    return same and all(saved.get(k) == now[k] for k in ("n", "seed", "n_groups"))


def evaluate(spark: SparkSession, store: str) -> DataFrame:
    s = spark.read.parquet(store)
    left, right = _nested(s, "protein").withColumnRenamed("item_id", "q"), _nested(s, "text").withColumnRenamed("item_id", "c")
    return ranking.recall(ranking.ranks(left, right), "ungrouped", [1, 5, 10])


def evaluate_grouped(spark: SparkSession, store: str, csv: str) -> DataFrame:
    """(direction, n, r1, r5, r10, map, median_rank, best_pos), rows of one uid being relevant to each other."""
    s = spark.read.parquet(store)
    groups = readers.read_pairs(spark, csv).select(F.col("row_idx").alias("item_id"), F.col("uid").alias("g"))
    one, two = (_nested(s, side).join(groups, "item_id") for side in SIDES)
    out = None
    for direction, a, b in (("protein to text", one, two), ("text to protein", two, one)):
        left, right = a.withColumnRenamed("item_id", "q"), b.withColumnRenamed("item_id", "c")
        row = ranking.measures(left, right, "g").withColumn("direction", F.lit(direction))
        out = row if out is None else out.union(row)
    return out


def decoys(spark: SparkSession, csv: str, out: str, labels: list[str], seed: int, allowed: list[str] | None = None, most_start: int = 1 << 30, most_tokens: int = 512, subset: int = 0, per_row: int = 2) -> None:
    """Writes plan, texts (with keep: the decoy differs from its owner within the first tokens) and stats (label, planned, usable)."""
    c = readers.read_captions(spark, csv, subset=subset).withColumn("split", F.lit(0))
    spans = captions.swap_filter(captions.fields(c, "text", labels, ["row_idx"]), [labels.index(x) for x in allowed or labels], most_start)
    captions.plan(c, spans, seed, per_row).write.mode("overwrite").parquet(out + "/plan")
    texts = captions.decoy_texts(c, spark.read.parquet(out + "/plan"))
    texts.withColumn("keep", captions.differs_when_truncated(F.col("text"), F.col("owner_text"), most_tokens)).drop("owner_text").write.mode("overwrite").parquet(out + "/texts")
    names = spark.createDataFrame(list(enumerate(labels)), "label_id int, label string")
    by = spark.read.parquet(out + "/texts").groupBy("label_id").agg(F.count("*").alias("planned"), F.count_if("keep").alias("usable"))
    stats = names.join(by, "label_id", "left").select("label", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("usable", F.lit(0)).alias("usable"))
    sinks.write_sidecar(stats, out + "/stats")


def inspect(spark: SparkSession, csv: str, store: str, uids: list[str], k: int = 3) -> DataFrame:
    wanted = spark.createDataFrame([(u,) for u in dict.fromkeys(uids)], "uid string")
    first = identity.first_rows(readers.read_pairs(spark, csv).join(F.broadcast(wanted), "uid", "left_semi"), "uid", "row_idx", ["text"])
    s = spark.read.parquet(store).join(F.broadcast(first.select(F.col("row_idx").alias("item_id"), "uid")), "item_id")
    both = _nested(s, "protein").withColumnRenamed("tokens", "a").join(_nested(s, "text").withColumnRenamed("tokens", "b"), "item_id")
    each = both.select("item_id", "b", F.posexplode("a").alias("i", "x")).select("item_id", "i", "x", F.posexplode("b").alias("j", "y"))
    best = each.groupBy("item_id", "i").agg(F.slice(F.array_sort(F.collect_list(F.struct((-dot(F.col("x"), F.col("y"))).alias("m"), "j"))), 1, k).alias("t"))
    return best.join(first.select(F.col("row_idx").alias("item_id"), "uid"), "item_id").select("uid", "i", F.explode("t").alias("t")).select("uid", "i", F.col("t.j").alias("j"), (-F.col("t.m")).alias("score"))


def export(spark: SparkSession, store: str, out: str, merged: str | None = None) -> None:
    """Mean vectors (modality, item_id, mean, n); with a merged folder also accessions (item_id, uid) and rows (row_idx, item_id)."""
    tokens = spark.read.parquet(store).withColumn("v", l2_normalize(F.col("v").cast("array<double>")))
    mean_vector(tokens, "v", ["modality", "item_id"]).write.mode("overwrite").parquet(out + "/pooled")
    if merged:
        stores.require(spark, merged)
        spark.read.parquet(merged + "/items").select("item_id", "uid").write.mode("overwrite").parquet(out + "/accessions")
        spark.read.parquet(merged + "/row_map").write.mode("overwrite").parquet(out + "/rows")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["encode", "merge", "means", "splits", "decoys", "evaluate", "inspect", "export", "diagnose", "roundtrip", "generated", "pack", "live", "score", "ablate", "settings"])
    p.add_argument("paths", nargs="*", type=named)
    p.add_argument("--encoder")
    p.add_argument("--subset", type=int, default=0)
    p.add_argument("--seed", type=int, default=13)
    p.add_argument("--labels", default="")
    p.add_argument("--allowed", default="")
    p.add_argument("--check", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--proteins", action="store_true")
    p.add_argument("--probe", type=int, default=256)
    p.add_argument("--kind", default="bf16")
    p.add_argument("--world", type=int, default=1)
    p.add_argument("--rank", type=int)
    p.add_argument("--weights", type=named)
    p.add_argument("--scorer")
    p.add_argument("--passes", type=int, default=8)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("pairforge").getOrCreate()
    ratios = (0.9, 0.05)
    if a.command == "encode":
        encode_csv(spark, a.paths[0], a.paths[1], a.encoder, a.subset)
    elif a.command == "means":
        for r in means(spark, a.paths[0]).collect():
            print(json.dumps({"modality": r.modality, "n": r.n, "mean": r["mean"]}))
    elif a.command == "splits":
        now = split_header(spark, a.paths[0], a.seed, ratios)
        saved = readers.read_sidecar(spark, a.paths[1] + "/header", "n long, seed long, ratios array<double>, n_groups long").first()
        good = saved is not None and fits(saved.asDict(), now)
        if a.check:
            return 0 if good else 1
        if a.force or not good:
            group_splits(spark, a.paths[0], a.seed, ratios).write.mode("overwrite").parquet(a.paths[1] + "/rows")
            sinks.write_sidecar(spark.createDataFrame([now], "n long, seed long, ratios array<double>, n_groups long"), a.paths[1] + "/header")
    elif a.command == "decoys":
        decoys(spark, a.paths[0], a.paths[1], [x for x in a.labels.split(",") if x], a.seed, [x for x in a.allowed.split(",") if x] or None, subset=a.subset)
    elif a.command == "merge":
        pairs = readers.read_pairs(spark, a.paths[0], subset=a.subset)
        if a.check:
            return 1 if stores.faults(spark, a.paths[1], pairs) else 0
        stores.merge(pairs, a.paths[1])
    elif a.command == "evaluate":
        for r in (evaluate_grouped(spark, *a.paths) if len(a.paths) > 1 else evaluate(spark, a.paths[0])).collect():
            print(json.dumps(r.asDict()))
    elif a.command == "inspect":
        inspect(spark, a.paths[0], a.paths[1], a.paths[2:]).show(100, False)
    elif a.command == "export":
        export(spark, *a.paths)
    elif a.command == "diagnose":
        tokens = spark.read.parquet(a.paths[0]).select(F.col("modality").alias("side"), "item_id", "pos", F.col("v").cast("array<double>").alias("v"))
        for r in geometry.spread_report(tokens, a.probe, seed=a.seed).collect():
            print(json.dumps(r.asDict()))
    elif a.command == "roundtrip":
        print(json.dumps(roundtrip.write(spark.read.parquet(a.paths[0]), a.paths[1], proteins=a.proteins)))
    elif a.command == "generated":
        sinks.write_report(roundtrip.generated_set(spark.read.parquet(a.paths[0])).orderBy("accession", "replicate"), a.paths[1], ",")
    elif a.command == "pack":
        pack(spark, *a.paths, kind=a.kind)
    elif a.command == "live":
        print(json.dumps(live(spark, *a.paths, world=a.world, rank=a.rank, encoder=a.encoder, model=a.weights, kind=a.kind, subset=a.subset)))
    elif a.command == "score":
        score(spark, *a.paths, scorer=a.scorer, passes=a.passes)
    elif a.command == "ablate":
        print(json.dumps(ablation.decomposition(spark.read.parquet(a.paths[0])).first().asDict()))
    elif a.command == "settings":
        for name, path in settings().items():
            print(json.dumps({"name": name, "path": path, "there": bool(path) and readers.exists(spark, path)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
