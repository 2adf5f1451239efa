"""Round trip: targets made from a source, encoded again, against the sources that they were made from.

Records: row_idx, uid, z_src, z_gen, z_true (normalised tokens), true_target, gen_target and, where there, pppl_gen and pppl_true.
Records of one uid are relevant to each other.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators import ranking
from pairforge.sources import sinks

#: The last one is what a perfect generator would reach.
COMPARISONS = {"generated_to_source": ("z_gen", "z_src"), "source_to_generated": ("z_src", "z_gen"), "true_to_source": ("z_true", "z_src")}
PERPLEXITIES = ("pppl_gen", "pppl_true")


def _side(records: DataFrame, tokens: str, name: str) -> DataFrame:
    return records.select(F.col("row_idx").alias(name), F.col(tokens).alias("tokens"), F.col("uid").alias("g"))


def measures(records: DataFrame) -> DataFrame:
    """(comparison, n, r1, r5, r10, median_rank, best_pos, map), one row a comparison.  Those with the same candidates share a pass, in which a true
    target that equals the generated one is scored once."""
    rows = []
    for b in dict.fromkeys(b for _, b in COMPARISONS.values()):
        sides = {name: _side(records, a, "q") for name, (a, other) in COMPARISONS.items() if other == b}
        rows += [row.withColumn("comparison", F.lit(name)) for name, row in ranking.measures_of(sides, _side(records, b, "c"), "g").items()]
    return functools.reduce(DataFrame.unionByName, rows)


def pairs(records: DataFrame) -> DataFrame:
    """(row_idx, id, rank, score, true_len, gen_len, true_target, generated_target): how each generated target finds its source."""
    r = ranking.ranks(_side(records, "z_gen", "q"), _side(records, "z_src", "c"), "g", ("grouped",))
    flat = records.select("row_idx", F.col("uid").alias("id"), *(F.trim(F.regexp_replace(c, r"\s+", " ")).alias(n) for c, n in (("true_target", "true_target"), ("gen_target", "generated_target"))))
    both = flat.join(r.select(F.col("q").alias("row_idx"), F.col("grouped").alias("rank"), "pos"), "row_idx")
    return both.select("row_idx", "id", "rank", F.format_string("%.4f", "pos").alias("score"), F.length("true_target").alias("true_len"), F.length("generated_target").alias("gen_len"), "true_target", "generated_target")


def perplexities(records: DataFrame) -> dict[str, float]:
    """Means over the records that have one; a measure that none has is left out."""
    there = [c for c in PERPLEXITIES if c in records.columns]
    means = records.agg(F.lit(0).alias("_"), *(F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in there)).first()
    return {c: means[c] for c in there if means[c] is not None}


def write(records: DataFrame, path: str, settings: Mapping[str, object] | None = None, proteins: bool = True) -> dict:
    """Metrics as JSON, pairs as TSV and, where the targets are proteins, both sequences of each record as FASTA; returns the metrics."""
    rows = {r.comparison: {k: v for k, v in r.asDict().items() if v is not None and k not in ("comparison", "n")} for r in measures(records).collect()}
    metrics = {"n": records.count(), **dict(settings or {}), **perplexities(records), **rows}
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/metrics")
    sinks.write_report(pairs(records).orderBy("row_idx").drop("row_idx"), path + "/pairs")
    if proteins:
        sinks.write_fasta(records.orderBy("row_idx"), path + "/sequences", "uid", {"true": "true_target", "generated": "gen_target"}, "row_idx")
    return metrics


def generated_set(candidates: DataFrame) -> DataFrame:
    """(accession, replicate, prompt, true_protein, generated_protein, select_score, true_len, gen_len): the best candidate of each replicate.

    Candidates: accession, replicate, j, prompt, true_protein, generated_protein, score.  Of equal scores the smallest j wins; a candidate
    without a score loses to any with one, and shows as nan.
    """
    scored = F.col("score").isNotNull() & ~F.isnan("score")
    order = F.struct(scored, F.when(scored, F.col("score")), -F.col("j"))
    best = F.max_by(F.struct("prompt", "true_protein", "generated_protein", F.when(scored, F.format_string("%.4f", "score")).otherwise("nan").alias("select_score")), order)
    won = candidates.groupBy("accession", "replicate").agg(best.alias("x")).select("accession", "replicate", "x.*")
    return won.withColumn("true_len", F.length("true_protein")).withColumn("gen_len", F.length("generated_protein"))
