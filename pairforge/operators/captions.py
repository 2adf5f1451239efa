"""Caption fields and decoys: parse labelled values, exchange them between rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.shared import keyed_hash, positions, settled

BREAK = "\x01"


def label_pattern(labels: list[str]) -> str:
    """Labels at the start or after white space, the longest first."""
    return r"(^|\s)(" + "|".join(re.escape(x) for x in sorted(labels, key=lambda x: (-len(x), x))) + ")"


def fields(df: DataFrame, text: str, labels: list[str], keep: list[str]) -> DataFrame:
    """(keep, fpos, label_id, vs, ve): value spans, 0-based and half-open; text before the first label and empty values are left out."""
    parts = F.split(F.regexp_replace(text, label_pattern(labels), f"$1{BREAK}$2"), BREAK)
    each = df.select(*keep, parts.alias("_parts")).select(*keep, "_parts", F.posexplode("_parts").alias("_k", "_part")).where("_k > 0")
    longest = sorted(labels, key=lambda x: (-len(x), x))
    label_id = F.coalesce(*(F.when(F.startswith("_part", F.lit(x)), F.lit(labels.index(x))) for x in longest))
    size = F.coalesce(*(F.when(F.startswith("_part", F.lit(x)), F.lit(len(x))) for x in longest))
    start = F.aggregate(F.slice("_parts", F.lit(1), F.col("_k")), F.lit(0), lambda a, x: a + F.length(x))
    each = each.select(*keep, (F.col("_k") - 1).alias("fpos"), label_id.alias("label_id"), (start + size).alias("_from"), F.expr("substring(_part, 1)").alias("_part"), size.alias("_size"))
    rest = F.expr("substring(_part, _size + 1)")
    lead = F.length(rest) - F.length(F.regexp_replace(rest, r"^\s+", ""))
    value = F.regexp_replace(F.regexp_replace(rest, r"^\s+", ""), r"\s+$", "")
    spans = each.select(*keep, "fpos", "label_id", (F.col("_from") + lead).alias("vs"), (F.col("_from") + lead + F.length(value)).alias("ve"))
    return spans.where("ve > vs")


def value(text: str, vs: str, ve: str) -> Column:
    return F.substring(F.col(text), F.col(vs) + 1, F.col(ve) - F.col(vs))


def splice(owner: Column, start: Column, end: Column, piece: Column) -> Column:
    return F.concat(F.substring(owner, F.lit(1), start), piece, F.substring(owner, end + 1, F.length(owner)))


def swap_filter(spans: DataFrame, allowed: list[int], most_start: int) -> DataFrame:
    return spans.where(F.col("label_id").isin(allowed) & (F.col("vs") <= most_start))


def spread(captions: DataFrame) -> DataFrame:
    """captions in ranges of row_idx, two a core at least: a table of few bytes is read by one task, and parsing is what costs."""
    spark = captions.sparkSession
    return captions.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "row_idx")


def plan(captions: DataFrame, spans: DataFrame, seed: int, per_row: int = 2, tries: int = 8, ranged: bool = False) -> DataFrame:
    """(owner_row, k, label_id, vs, ve, donor_row, dvs, dve, piece): up to `per_row` exchanges a row, from the same split; piece is the donor's value.

    captions: row_idx, uid, split, text; spans: `fields` of them, which may keep all four.  The row's spans are taken in hash order, again by hash when there are
    fewer than slots.  Each slot draws donors by hash from its label's pool and keeps the first that is another row of another uid with another value: the
    first draw is made for all, the others only for slots that it leaves without a donor.  ranged: spans come from captions as `spread` deals them.
    """
    own = spans if {"uid", "split", "text"} <= set(spans.columns) else spans.join(captions.select("row_idx", "uid", "split", "text"), "row_idx")
    own = own.withColumn("value", value("text", "vs", "ve")).select("row_idx", "uid", "split", "fpos", "label_id", "vs", "ve", "value")
    pool = settled(positions(own, ["row_idx", "fpos"], ["label_id", "split"], "pool_pos", ranged=ranged))
    sizes = pool.groupBy("label_id", "split").agg(F.count("*").alias("pool_size"))
    ranked = F.array_sort(F.collect_list(F.struct(keyed_hash(seed, "s", F.col("row_idx"), F.col("fpos")).alias("h"), "fpos", "label_id", "vs", "ve", "value")))
    rows = pool.groupBy("row_idx", "uid", "split").agg(ranked.alias("spans"))
    slots = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1)))).withColumn("n", F.size("spans"))
    pick = F.when(F.col("k") < F.col("n"), F.col("k").cast("long")).otherwise(keyed_hash(seed, "w", F.col("row_idx"), F.col("k")) % F.col("n"))
    slots = slots.withColumn("_s", F.element_at("spans", (pick + 1).cast("int"))).select("row_idx", "uid", "split", "k", "_s.label_id", "_s.vs", "_s.ve", "_s.value")
    slots = slots.join(F.broadcast(sizes), ["label_id", "split"])
    donors = pool.select("label_id", "split", "pool_pos", F.col("row_idx").alias("donor_row"), F.col("uid").alias("_du"), F.col("vs").alias("dvs"), F.col("ve").alias("dve"), F.col("value").alias("piece"))
    good = F.expr("donor_row <> row_idx and _du <> uid and piece <> value")
    found = ["label_id", "vs", "ve", "donor_row", "dvs", "dve", "piece"]

    def drawn(slots: DataFrame, t: Column) -> DataFrame:
        draws = slots.withColumn("t", t).withColumn("pool_pos", keyed_hash(seed, "d", F.col("row_idx"), F.col("k"), F.col("t")) % F.col("pool_size"))
        return draws.join(donors, ["label_id", "split", "pool_pos"])

    once = settled(drawn(slots, F.lit(0)).withColumn("_good", F.coalesce(good, F.lit(False))), "draws")
    first = once.where("_good").select(F.col("row_idx").alias("owner_row"), "k", *found)
    if tries < 2:
        return first
    left = once.where("not _good").select(*slots.columns)
    more = drawn(left, F.explode(F.sequence(F.lit(1), F.lit(tries - 1)))).where(good)
    more = more.groupBy(F.col("row_idx").alias("owner_row"), "k").agg(F.min_by(F.struct(*found), "t").alias("_p")).select("owner_row", "k", "_p.*")
    return first.union(more)


def decoy_texts(captions: DataFrame, plan_: DataFrame) -> DataFrame:
    """(owner_row, k, label_id, donor_row, text, owner_text) of each planned exchange."""
    both = plan_.join(captions.select(F.col("row_idx").alias("owner_row"), F.col("text").alias("_o")), "owner_row")
    return both.select("owner_row", "k", "label_id", "donor_row", splice(F.col("_o"), F.col("vs"), F.col("ve"), F.col("piece")).alias("text"), F.col("_o").alias("owner_text"))


def differs_when_truncated(decoy: Column, owner: Column, most: int) -> Column:
    """Whether the first `most` blank-separated tokens differ."""
    cut = lambda c: F.slice(F.split(c, " "), 1, most)
    return cut(decoy) != cut(owner)
