"""Queries over token vectors: stores, normalisation, means, geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairforge.functions.shared import keyed_hash, rounded, settled, sql_hash
from pairforge.functions.vectors import dot, mean_vector, norm, subtract
from pairforge.functions.vectors import l2_normalize as unit
from pairforge.operators.geometry import off_diagonal
from pairforge.plans.base import TOK, items, query, tok, with_

T = with_(TOK)
R = lambda x: f"round({x}, 6) + 0.0::DOUBLE"
SIDE = "CASE WHEN vec_id % 2 = 0 THEN 'p' ELSE 't' END"


def side():
    return F.when(F.col("vec_id") % 2 == 0, "p").otherwise("t")


@query(T + f"SELECT vec_id AS item_id, pos, {R('v[1]')} AS v_first, {R('v[16]')} AS v_last, CAST(len(v) AS BIGINT) AS width FROM tok")
def token_table(spark, sf):
    return tok(spark, sf).select(F.col("vec_id").alias("item_id"), "pos", rounded(F.element_at("v", 1)).alias("v_first"), rounded(F.element_at("v", 16)).alias("v_last"), F.size("v").cast("long").alias("width"))


@query(T + f", dim AS (SELECT label, min(vec_id) AS protein_idx FROM embeddings GROUP BY label) SELECT t.vec_id AS row_idx, d.protein_idx, t.pos, {R('list_dot_product(t.v, p.v)')} AS s FROM tok t JOIN dim d USING (label) JOIN tok p ON p.vec_id = d.protein_idx AND p.pos = t.pos")
def pair_join(spark, sf):
    t = tok(spark, sf)
    dim = t.groupBy("label").agg(F.min("vec_id").alias("protein_idx"))
    p = t.join(dim.select(F.col("protein_idx").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("protein_idx"), "pos", F.col("v").alias("pv"))
    return t.join(dim, "label").join(p, ["protein_idx", "pos"]).select(F.col("vec_id").alias("row_idx"), "protein_idx", "pos", rounded(dot(F.col("v"), F.col("pv"))).alias("s"))


@query(T + f"SELECT vec_id, pos, {R('sqrt(list_dot_product(r, r))')} AS before, {R('sqrt(list_dot_product(v, v))')} AS after, {R('v[2]')} AS second FROM tok")
def l2_normalize(spark, sf):
    return tok(spark, sf).select("vec_id", "pos", rounded(norm(F.col("r"))).alias("before"), rounded(norm(F.col("v"))).alias("after"), rounded(F.element_at("v", 2)).alias("second"))


MEAN = "long AS (SELECT vec_id, pos, CAST(unnest(range(16)) AS INTEGER) AS d, unnest(v) AS x FROM tok), mean AS (SELECT d, avg(x) AS m, count(*) AS n FROM long GROUP BY d)"


@query(with_(TOK, MEAN) + f"SELECT vec_id, pos, max({R('x - m')}) FILTER (WHERE d = 0) AS first, max({R('x - m')}) FILTER (WHERE d = 15) AS last FROM long JOIN mean USING (d) GROUP BY vec_id, pos")
def center_vectors(spark, sf):
    t = tok(spark, sf)
    c = t.crossJoin(F.broadcast(mean_vector(t, "v"))).withColumn("c", subtract(F.col("v"), F.col("mean")))
    return c.select("vec_id", "pos", rounded(F.element_at("c", 1)).alias("first"), rounded(F.element_at("c", 16)).alias("last"))


@query(with_(TOK, MEAN) + f"SELECT d, {R('m')} AS mean, n FROM mean")
def corpus_mean_vector(spark, sf):
    return mean_vector(tok(spark, sf), "v").select(F.posexplode("mean").alias("d", "m"), "n").select("d", rounded(F.col("m")).alias("mean"), "n")


POOL = f"pool AS (SELECT vec_id, {SIDE} AS side, d, avg(x) AS m FROM long GROUP BY vec_id, d), vecs AS (SELECT vec_id, side, list(m ORDER BY d) AS z FROM pool GROUP BY vec_id, side)"


def pooled(spark, sf, *more):
    """(vec_id, side, z): the mean of each item's tokens, inside its row."""
    it = items(spark, sf).withColumn("side", side())
    total = F.aggregate(F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0))), F.element_at("tokens", 1), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return it.select("vec_id", "side", "label", F.transform(total, lambda x: x / F.greatest(F.size("tokens"), F.lit(1))).alias("z"), *more)


@query(with_(TOK, MEAN, POOL) + f"SELECT vec_id, {R('sqrt(list_dot_product(z, z))')} AS norm, {R('z[1] / greatest(sqrt(list_dot_product(z, z)), 1e-12)')} AS first, {R('z[16] / greatest(sqrt(list_dot_product(z, z)), 1e-12)')} AS last FROM vecs")
def pooled_embeddings(spark, sf):
    z = pooled(spark, sf).withColumn("n", norm(F.col("z")))
    at = lambda k: rounded(F.element_at("z", k) / F.greatest("n", F.lit(1e-12)))
    return z.select("vec_id", rounded(F.col("n")).alias("norm"), at(1).alias("first"), at(16).alias("last"))


SIDES = f"sides AS (SELECT side, list(m ORDER BY d) AS z, any_value(n) AS n FROM (SELECT {SIDE} AS side, d, avg(x) AS m, count(*) AS n FROM long GROUP BY side, d) GROUP BY side)"


def sides(spark, sf):
    m = mean_vector(tok(spark, sf).withColumn("side", side()), "v", ["side"])
    return m.groupBy().agg(F.max_by("mean", F.col("side") == "p").alias("p"), F.max_by("mean", F.col("side") == "t").alias("t"))


@query(with_(TOK, MEAN, SIDES) + f"SELECT {R('sqrt(list_sum(list_transform(list_zip(p.z, t.z), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))')} AS gap_l2 FROM sides p, sides t WHERE p.side = 'p' AND t.side = 't'")
def modality_gap(spark, sf):
    return sides(spark, sf).select(rounded(norm(subtract(F.col("p"), F.col("t")))).alias("gap_l2"))


@query(with_(TOK, MEAN, SIDES) + f"SELECT {R('list_dot_product(p.z, t.z)')} AS cross_cos FROM sides p, sides t WHERE p.side = 'p' AND t.side = 't'")
def mean_cross_cos(spark, sf):
    # the mean over all token pairs is the product of the means: no pair is formed
    return sides(spark, sf).select(rounded(dot(F.col("p"), F.col("t"))).alias("cross_cos"))


@query(with_(TOK, MEAN, SIDES) + f"SELECT side, {R('(n::DOUBLE * n * list_dot_product(z, z) - sq) / (n::DOUBLE * (n - 1))')} AS intra_cos FROM sides JOIN (SELECT {SIDE} AS side, sum(list_dot_product(v, v)) AS sq FROM tok GROUP BY side) USING (side)")
def mean_intra_cos(spark, sf):
    t = tok(spark, sf).withColumn("side", side())
    m = mean_vector(t, "v", ["side"]).join(t.groupBy("side").agg(F.sum(dot(F.col("v"), F.col("v"))).alias("sq")), "side")
    return m.select("side", rounded(off_diagonal(F.col("mean"), F.col("n").cast("double"), F.col("sq"))).alias("intra_cos"))


@query(with_(TOK, MEAN, POOL) + f"SELECT {R('avg(list_dot_product(p.z, t.z))')} AS pos_cos FROM vecs p JOIN vecs t ON p.vec_id + 1 = t.vec_id WHERE p.side = 'p'")
def mean_pos_cos(spark, sf):
    z = pooled(spark, sf)
    p = z.where("side = 'p'").select(F.expr("vec_id div 2").alias("k"), F.col("z").alias("a"))
    t = z.where("side = 't'").select(F.expr("vec_id div 2").alias("k"), F.col("z").alias("b"))
    return p.join(t, "k").agg(rounded(F.avg(dot(F.col("a"), F.col("b")))).alias("pos_cos"))


@query(
    with_(TOK, MEAN, POOL, SIDES)
    + f""", per AS (SELECT {SIDE} AS side, avg((16 * list_dot_product(z, z) - sq) / 12) AS within FROM vecs JOIN (SELECT vec_id, sum(list_dot_product(v, v)) AS sq FROM tok GROUP BY vec_id) USING (vec_id) GROUP BY 1),
u AS (SELECT vec_id, side, list_transform(z, lambda x: x / greatest(sqrt(list_dot_product(z, z)), 1e-12)) AS z FROM vecs),
ul AS (SELECT vec_id, side, CAST(unnest(range(16)) AS INTEGER) AS d, unnest(z) AS x FROM u), um AS (SELECT side, d, avg(x) AS m, count(*) AS n FROM ul GROUP BY side, d),
umv AS (SELECT side, list(m ORDER BY d) AS m, any_value(n) AS n FROM um GROUP BY side),
raw AS (SELECT u.side, (any_value(n)::DOUBLE * any_value(n) * list_dot_product(any_value(m), any_value(m)) - sum(list_dot_product(z, z))) / (any_value(n)::DOUBLE * (any_value(n) - 1)) AS pooled, avg(abs(list_dot_product(z, m) / greatest(sqrt(list_dot_product(m, m)), 1e-12))) AS to_mean FROM u JOIN umv USING (side) GROUP BY u.side),
cz AS (SELECT vec_id, u.side, list_transform(list_zip(z, m), lambda x: x[1] - x[2]) AS c FROM u JOIN umv USING (side)),
cn AS (SELECT vec_id, side, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) AS c FROM cz),
cl AS (SELECT vec_id, side, CAST(unnest(range(16)) AS INTEGER) AS d, unnest(c) AS x FROM cn),
cm AS (SELECT side, sum(m * m) AS mm, any_value(n) AS n FROM (SELECT side, d, avg(x) AS m, count(*) AS n FROM cl GROUP BY side, d) GROUP BY side),
cs AS (SELECT side, sum(list_dot_product(c, c)) AS sq FROM cn GROUP BY side)
SELECT per.side, {R('within')} AS within, {R('pooled')} AS pooled, {R('(n::DOUBLE * n * mm - sq) / (n::DOUBLE * (n - 1))')} AS centered, {R('to_mean')} AS to_mean FROM per JOIN raw USING (side) JOIN cm USING (side) JOIN cs USING (side)"""
)
def anisotropy_report(spark, sf):
    """Mean off-diagonal cosine within items, of pooled vectors raw and centred, and the mean absolute cosine to the mean."""
    # one pass over the tokens; the rest reads one short row an item
    z = settled(pooled(spark, sf, F.aggregate("tokens", F.lit(0.0), lambda s, v: s + dot(v, v)).alias("sq")).drop("label"))
    within = z.groupBy("side").agg(F.avg((16 * dot(F.col("z"), F.col("z")) - F.col("sq")) / 12).alias("within"))
    u = z.select("side", unit(F.col("z")).alias("u"))
    m = mean_vector(u, "u", ["side"])
    both = u.join(F.broadcast(m), "side")
    to_mean = F.abs(dot(F.col("u"), F.col("mean")) / F.greatest(norm(F.col("mean")), F.lit(1e-12)))
    raw = both.groupBy("side").agg(F.sum(dot(F.col("u"), F.col("u"))).alias("sq"), F.avg(to_mean).alias("to_mean")).join(m, "side")
    raw = raw.select("side", off_diagonal(F.col("mean"), F.col("n").cast("double"), F.col("sq")).alias("pooled"), "to_mean")
    c = both.select("side", unit(subtract(F.col("u"), F.col("mean"))).alias("c"))
    cm = mean_vector(c, "c", ["side"]).join(c.groupBy("side").agg(F.sum(dot(F.col("c"), F.col("c"))).alias("sq")), "side")
    cm = cm.select("side", off_diagonal(F.col("mean"), F.col("n").cast("double"), F.col("sq")).alias("centered"))
    out = within.join(raw, "side").join(cm, "side")
    return out.select("side", *(rounded(F.col(x)).alias(x) for x in ("within", "pooled", "centered", "to_mean")))


MOST = 4096
HASHED = f"sample AS (SELECT side, v, row_number() OVER (PARTITION BY side ORDER BY h, vec_id, pos) AS id FROM (SELECT *, {SIDE} AS side, {sql_hash('3', 'vec_id', 'pos')} AS h FROM tok) QUALIFY id <= {MOST})"
UNIFORM = f"uniform AS (SELECT a.side, ln(avg(exp(-2 * (2 - 2 * list_dot_product(a.v, b.v))))) AS u FROM sample a JOIN sample b ON a.side = b.side AND a.id <> b.id GROUP BY a.side)"


def uniformity(spark, sf, t: float = 2.0):
    """log mean exp(-t |a - b|^2) over pairs of different tokens, of at most 4096 tokens a side (the measure's own cap)."""
    hashed = tok(spark, sf).withColumn("side", side()).withColumn("h", keyed_hash(3, F.col("vec_id"), F.col("pos")))
    sample = None
    for s in ("p", "t"):
        top = hashed.where(F.col("side") == s).orderBy("h", "vec_id", "pos").limit(MOST).select("side", "v")
        sample = top if sample is None else sample.union(top)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf.v.to_numpy())
        n = len(z)
        if n < 2:
            return pd.DataFrame({"side": pdf.side[:1], "u": [0.0]})
        e = np.exp(-t * (2 - 2 * (z @ z.T)))
        return pd.DataFrame({"side": pdf.side[:1], "u": [float(np.log((e.sum() - np.trace(e)) / (n * (n - 1))))]})

    return sample.groupBy("side").applyInPandas(one, "side string, u double")


@query(with_(TOK, HASHED, UNIFORM) + f"SELECT side, {R('u')} AS uniformity FROM uniform")
def token_uniformity(spark, sf):
    return uniformity(spark, sf).select("side", rounded(F.col("u")).alias("uniformity"))


RECON = f"recon AS (SELECT {SIDE} AS side, avg(e) AS mse FROM (SELECT vec_id, pos, avg((round(x, 1) - x) * (round(x, 1) - x)) AS e FROM long GROUP BY vec_id, pos) GROUP BY 1)"


def reconstruction(spark, sf):
    """Tokens against tenths of themselves: the mean over dimensions, then over tokens."""
    err = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.round(x, 1) - x) * (F.round(x, 1) - x)) / F.size("v")
    return tok(spark, sf).withColumn("side", side()).groupBy("side").agg(F.avg(err).alias("mse"))


@query(with_(TOK, MEAN, RECON) + f"SELECT side, {R('mse')} AS mse FROM recon")
def reconstruction_mse(spark, sf):
    return reconstruction(spark, sf).select("side", rounded(F.col("mse")).alias("mse"))


CELL = TOK + ", cell AS (SELECT p.vec_id // 2 AS k, p.pos AS i, t.pos AS j, list_dot_product(p.v, t.v) AS s FROM tok p JOIN tok t ON p.vec_id + 1 = t.vec_id WHERE p.vec_id % 2 = 0)"


def cells(spark, sf):
    """(k, i, j, s): the token similarities of each pair, from the two rows of the pair."""
    it = items(spark, sf).withColumn("k", F.expr("vec_id div 2"))
    both = it.where("vec_id % 2 = 0").select("k", F.col("tokens").alias("a")).join(it.where("vec_id % 2 = 1").select("k", F.col("tokens").alias("b")), "k")
    each = both.select("k", "b", F.posexplode("a").alias("i", "x")).select("k", "i", "x", F.posexplode("b").alias("j", "y"))
    return each.select("k", "i", "j", dot(F.col("x"), F.col("y")).alias("s"))


@query(with_(CELL) + f"SELECT k, i, j, {R('s')} AS s FROM cell")
def similarity_matrix(spark, sf):
    return cells(spark, sf).select("k", "i", "j", rounded(F.col("s")).alias("s"))


@query(with_(CELL) + f"""SELECT k, a AS i, b AS j, {R('s')} AS s FROM (SELECT *, CASE WHEN (k + i) % 3 = 0 THEN 0 ELSE 1 END AS vi, CASE WHEN (k + j) % 4 = 0 THEN 0 ELSE 1 END AS vj FROM cell)
JOIN (SELECT k, i, sum(CASE WHEN (k + i) % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) - 1 AS a FROM (SELECT DISTINCT k, i FROM cell)) USING (k, i)
JOIN (SELECT k, j, sum(CASE WHEN (k + j) % 4 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY j) - 1 AS b FROM (SELECT DISTINCT k, j FROM cell)) USING (k, j) WHERE vi = 1 AND vj = 1 AND a < 2 AND b < 3""".replace("SELECT k, a AS i, b AS j", "SELECT k, CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j"))
def clipped_matrix(spark, sf):
    """Valid tokens only (here by a rule on place), at most 2 by 3 of them."""
    c = cells(spark, sf)
    valid = lambda x, m: ((F.col("k") + F.col(x)) % m != 0)
    before = lambda x, m: F.aggregate(F.sequence(F.lit(0), F.col(x)), F.lit(0), lambda s, p: s + F.when((F.col("k") + p) % m == 0, 0).otherwise(1)) - 1
    out = c.where(valid("i", 3) & valid("j", 4)).withColumn("a", before("i", 3)).withColumn("b", before("j", 4)).where("a < 2 and b < 3")
    return out.select("k", F.col("a").cast("long").alias("i"), F.col("b").cast("long").alias("j"), rounded(F.col("s")).alias("s"))


@query(with_(CELL) + f"SELECT k, i, rank, j, {R('s')} AS s FROM (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY round(s, 9) DESC, j) AS rank FROM cell) WHERE rank <= 2")
def topk_alignments(spark, sf):
    c = cells(spark, sf)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("s", 9)).alias("m"), "j", "s"))), 1, 2)
    each = c.groupBy("k", "i").agg(best.alias("t")).select("k", "i", F.posexplode("t").alias("p", "x"))
    return each.select("k", "i", (F.col("p") + 1).cast("long").alias("rank"), F.col("x.j").alias("j"), rounded(F.col("x.s")).alias("s"))


