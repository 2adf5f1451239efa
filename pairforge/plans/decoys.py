"""Queries over captions: fields, decoy plans, decoy texts and the losses on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pairforge.functions.shared import keyed_hash, rounded, settled, sql_hash
from pairforge.operators import captions as C
from pairforge.operators import maxsim
from pairforge.plans.base import CAP, LABELS, PAIR, captions, pairs, query, with_
from pairforge.plans.tokens import R

SEED, PER_ROW, TRIES, ALLOWED, MOST_START, MOST_TOKENS, SCALE, MARGIN = 7, 2, 8, [0, 2], 40, 6, 20.0, 0.2
F_ = with_(CAP)


def fields(spark, sf):
    return C.fields(captions(spark, sf), "text", LABELS, ["row_idx"])


@query(F_ + "SELECT row_idx, CAST(fpos AS INTEGER) AS fpos, CAST(label_id AS INTEGER) AS label_id, vs, ve, val AS value FROM spans")
def caption_fields(spark, sf):
    c = captions(spark, sf)
    f = C.fields(c, "text", LABELS, ["row_idx", "text"])
    return f.select("row_idx", "fpos", "label_id", F.col("vs").cast("long").alias("vs"), F.col("ve").cast("long").alias("ve"), C.value("text", "vs", "ve").alias("value"))


@query(F_ + "SELECT label_id, split, count(*) AS spans, count(DISTINCT val) AS distinct_values, min(vs) AS least_start, max(ve) AS greatest_end FROM (SELECT row_idx, CAST(label_id AS INTEGER) AS label_id, vs, ve, val FROM spans) JOIN cap USING (row_idx) GROUP BY label_id, split")
def field_index(spark, sf):
    own = C.fields(captions(spark, sf), "text", LABELS, ["row_idx", "split", "text"]).withColumn("value", C.value("text", "vs", "ve"))
    by = own.groupBy("label_id", "split", "value").agg(F.count("*").alias("n"), F.min("vs").alias("a"), F.max("ve").alias("b"))
    return by.groupBy("label_id", "split").agg(F.sum("n").alias("spans"), F.count("*").alias("distinct_values"), F.min("a").cast("long").alias("least_start"), F.max("b").cast("long").alias("greatest_end"))


@query(F_ + f"SELECT row_idx, CAST(fpos AS INTEGER) AS fpos, CAST(label_id AS INTEGER) AS label_id, vs, ve FROM spans WHERE label_id IN (0, 2) AND vs <= {MOST_START}")
def decoy_swap_filter(spark, sf):
    f = C.swap_filter(fields(spark, sf), ALLOWED, MOST_START)
    return f.select("row_idx", "fpos", "label_id", F.col("vs").cast("long").alias("vs"), F.col("ve").cast("long").alias("ve"))


PLAN = f"""own AS (SELECT row_idx, uid, split, CAST(fpos AS INTEGER) AS fpos, CAST(label_id AS INTEGER) AS label_id, vs, ve, val FROM spans JOIN cap USING (row_idx)),
pool AS (SELECT *, row_number() OVER (PARTITION BY label_id, split ORDER BY row_idx, fpos) - 1 AS pool_pos, count(*) OVER (PARTITION BY label_id, split) AS pool_size,
row_number() OVER (PARTITION BY row_idx ORDER BY {sql_hash(str(SEED), "'s'", 'row_idx', 'fpos')}, fpos) - 1 AS s, count(*) OVER (PARTITION BY row_idx) AS n FROM own),
slots AS (SELECT p.row_idx, p.uid, p.split, CAST(k AS INTEGER) AS k, p.label_id, p.vs, p.ve, p.val, p.pool_size FROM pool p CROSS JOIN range({PER_ROW}) t(k) WHERE p.s = CASE WHEN k < n THEN k ELSE {sql_hash(str(SEED), "'w'", 'p.row_idx', 'k')} % n END),
draws AS (SELECT s.*, t, {sql_hash(str(SEED), "'d'", 's.row_idx', 's.k', 't')} % s.pool_size AS pp FROM slots s CROSS JOIN range({TRIES}) r(t)),
good AS (SELECT d.*, p.row_idx AS donor_row, p.vs AS dvs, p.ve AS dve, row_number() OVER (PARTITION BY d.row_idx, d.k ORDER BY t) AS o FROM draws d JOIN pool p ON p.label_id = d.label_id AND p.split = d.split AND p.pool_pos = d.pp WHERE p.row_idx <> d.row_idx AND p.uid <> d.uid AND p.val <> d.val),
plan AS (SELECT row_idx AS owner_row, k, label_id, vs, ve, donor_row, dvs, dve FROM good WHERE o = 1)"""


def plan(spark, sf):
    c = C.spread(captions(spark, sf))
    return C.plan(c, C.fields(c, "text", LABELS, ["row_idx", "uid", "split", "text"]), SEED, PER_ROW, TRIES, ranged=True)


@query(with_(CAP, PLAN) + "SELECT * FROM plan")
def decoy_plan(spark, sf):
    return plan(spark, sf).select("owner_row", "k", "label_id", *(F.col(c).cast("long").alias(c) for c in ("vs", "ve", "donor_row", "dvs", "dve")))


TEXTS = "texts AS (SELECT owner_row, k, label_id, substr(o.text, 1, vs) || substr(d.text, dvs + 1, dve - dvs) || substr(o.text, ve + 1) AS text, o.text AS owner_text FROM plan JOIN cap o ON o.row_idx = owner_row JOIN cap d ON d.row_idx = donor_row)"


def texts(spark, sf):
    return C.decoy_texts(captions(spark, sf), plan(spark, sf))


@query(with_(CAP, PLAN, TEXTS) + "SELECT owner_row, k, label_id, text FROM texts")
def decoy_texts(spark, sf):
    return texts(spark, sf).drop("owner_text", "donor_row")


KEPT = f"kept AS (SELECT owner_row, k, label_id, list_slice(string_split(text, ' '), 1, {MOST_TOKENS}) <> list_slice(string_split(owner_text, ' '), 1, {MOST_TOKENS}) AS keep FROM texts)"


def kept(spark, sf):
    return texts(spark, sf).select("owner_row", "k", "label_id", "donor_row", C.differs_when_truncated(F.col("text"), F.col("owner_text"), MOST_TOKENS).alias("keep"))


@query(with_(CAP, PLAN, TEXTS, KEPT) + "SELECT owner_row, k, keep FROM kept")
def decoy_keep(spark, sf):
    return kept(spark, sf).select("owner_row", "k", "keep")


@query(with_(CAP, PLAN, TEXTS, KEPT) + f"SELECT label, coalesce(planned, 0) AS planned, coalesce(usable, 0) AS usable, rows_without, slots_without FROM (VALUES (0, 'NAME:'), (1, 'TYPE:'), (2, 'BRAND:')) l(id, label) LEFT JOIN (SELECT label_id, count(*) AS planned, count(*) FILTER (WHERE keep) AS usable FROM kept GROUP BY label_id) ON id = label_id CROSS JOIN (SELECT count(*) - (SELECT count(DISTINCT owner_row) FROM kept) AS rows_without, {PER_ROW} * count(*) - (SELECT count(*) FROM kept) AS slots_without FROM cap)")
def decoy_stats(spark, sf):
    k = kept(spark, sf)
    by = k.groupBy("label_id").agg(F.count("*").alias("planned"), F.count_if("keep").alias("usable"))
    owners = k.groupBy("owner_row").agg(F.count("*").alias("c")).agg(F.count("*").alias("owners"), F.coalesce(F.sum("c"), F.lit(0)).alias("slots"))
    rows = captions(spark, sf).agg(F.count("*").alias("n")).crossJoin(owners)
    labels = spark.createDataFrame(list(enumerate(LABELS)), "label_id int, label string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = labels.join(by, "label_id", "left").crossJoin(F.broadcast(rows))
    return out.select("label", zero("planned"), zero("usable"), (F.col("n") - F.col("owners")).alias("rows_without"), (PER_ROW * F.col("n") - F.col("slots")).alias("slots_without"))


@query(with_(CAP, PLAN, TEXTS, KEPT) + f"SELECT c.row_idx, CAST(count(k.k) AS BIGINT) AS n_kept, CAST(arg_min(k.k, {sql_hash('19', 'k.owner_row', 'k.k')}) AS INTEGER) AS chosen FROM cap c LEFT JOIN kept k ON k.owner_row = c.row_idx AND k.keep GROUP BY c.row_idx")
def decoy_candidates(spark, sf):
    """Every row with its usable decoys, at most one of them chosen by hash."""
    k = kept(spark, sf).where("keep").groupBy(F.col("owner_row").alias("row_idx")).agg(F.count("*").alias("n"), F.min_by("k", keyed_hash(19, F.col("owner_row"), F.col("k"))).alias("chosen"))
    return captions(spark, sf).select("row_idx").join(k, "row_idx", "left").select("row_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n_kept"), F.col("chosen").cast("int").alias("chosen"))


LOSS = f"""npairs AS (SELECT count(DISTINCT q) AS n FROM lt),
keyed AS (SELECT owner_row, k, keep, owner_row % n AS q, (SELECT any_value(donor_row) FROM plan p WHERE p.owner_row = kept.owner_row AND p.k = kept.k) % n AS c FROM kept CROSS JOIN npairs),
dscored AS (SELECT owner_row, k, s.score AS neg, p.score AS pos FROM keyed d JOIN scores s ON s.q = d.q AND s.c = d.c JOIN scores p ON p.q = d.q AND p.c = d.q WHERE keep AND d.c <> d.q),
anchors AS (SELECT owner_row, any_value(pos) AS pos, max(neg) AS worst, count(*) AS m, sum(greatest(0, {MARGIN} - (pos - neg))) AS hinge, ln(exp({SCALE} * (any_value(pos) - 1)) + sum(exp({SCALE} * (neg - 1)))) - {SCALE} * (any_value(pos) - 1) AS soft FROM dscored GROUP BY owner_row)"""


ITEM_BYTES, HELD_BYTES = 640, 64 << 20  # of an item's nested tokens in memory; of the items that a worker holds of a side


def scored(decoys, left, other, n):
    """(owner_row, pos, neg): decoys (owner_row, q, c) with the scores of the pairs (q, q) and (q, c); left: q, tokens; other: c, other; n: items a side.

    Vectors do not travel with decoys: the other side's items are broadcast, in as many passes as keep what is held below HELD_BYTES, one after the other.
    """
    score = F.round(maxsim.nested(F.col("tokens"), F.col("other")), 9)
    own = left.join(other.withColumnRenamed("c", "q"), "q").select("q", "tokens", score.alias("pos"))
    meet = lambda d, own, other: d.join(own, "q").join(F.broadcast(other), "c").select("owner_row", "pos", score.alias("neg"))
    passes = max(1, -(-n * ITEM_BYTES // HELD_BYTES))
    if passes == 1:
        return meet(decoys, F.broadcast(own), other)
    decoys, own, other = settled(decoys, "decoys"), settled(own, "own"), settled(other, "other")
    part = lambda df, p: df.where(F.pmod("c", F.lit(passes)) == p)
    return reduce(lambda x, y: x.union(y), [settled(meet(part(decoys, p), own, part(other, p)), "scored") for p in range(passes)])


def anchors(spark, sf):
    """(owner_row, pos, worst, m, hinge, soft): each anchor against its own usable decoys, by key."""
    left, right = pairs(spark, sf)
    n = left.count()
    of = lambda row: F.col(row) % F.lit(n or None).cast("long")
    d = kept(spark, sf).where("keep").select("owner_row", of("owner_row").alias("q"), of("donor_row").alias("c")).where("q <> c")
    both = scored(d, left.select("q", "tokens"), right.select("c", F.col("tokens").alias("other")), n)
    x = lambda v: F.exp(SCALE * (v - 1))
    soft = F.log(x(F.max("pos")) + F.sum(x(F.col("neg")))) - SCALE * (F.max("pos") - 1)
    return both.groupBy("owner_row").agg(F.max("pos").alias("pos"), F.max("neg").alias("worst"), F.count("*").alias("m"), F.sum(F.greatest(F.lit(0.0), MARGIN - (F.col("pos") - F.col("neg")))).alias("hinge"), soft.alias("soft"))


@query(with_(CAP, PLAN, TEXTS, KEPT, PAIR, LOSS) + f"SELECT {R('avg(soft)')} AS softmax_loss, {R('sum(hinge) / sum(m)')} AS hinge_loss, {R('avg((pos > worst)::INT::DOUBLE)')} AS acc, {R('avg(pos - worst)')} AS margin, {R('avg(worst)')} AS worst, count(*) AS anchors FROM anchors")
def hard_decoy_loss(spark, sf):
    a = anchors(spark, sf)
    return a.agg(rounded(F.avg("soft")).alias("softmax_loss"), rounded(F.sum("hinge") / F.sum("m")).alias("hinge_loss"), rounded(F.avg((F.col("pos") > F.col("worst")).cast("double"))).alias("acc"), rounded(F.avg(F.col("pos") - F.col("worst"))).alias("margin"), rounded(F.avg("worst")).alias("worst"), F.count("*").alias("anchors"))


@query(with_(CAP, PLAN, TEXTS, KEPT, PAIR, LOSS) + f"SELECT split, {R('sum(soft) / count(*)')} AS loss, {R('sum((pos > worst)::INT::DOUBLE) / count(*)')} AS acc, count(*) AS rows FROM anchors JOIN cap ON row_idx = owner_row GROUP BY split")
def decoy_eval(spark, sf):
    """Row-weighted means over the splits: one aggregate instead of means of batches."""
    a = anchors(spark, sf).join(captions(spark, sf).select(F.col("row_idx").alias("owner_row"), "split"), "owner_row")
    return a.groupBy("split").agg(rounded(F.sum("soft") / F.count("*")).alias("loss"), rounded(F.sum((F.col("pos") > F.col("worst")).cast("double")) / F.count("*")).alias("acc"), F.count("*").alias("rows"))
