"""Queries over scored pairs: late interaction, ranks, objectives, selection, rewards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairforge.functions.shared import number_text, rounded, settled, sql_hash
from pairforge.operators import maxsim, ranking, splits
from pairforge.operators.quantiles import quantiles
from pairforge.plans.base import PAIR, pairs, query, with_
from pairforge.plans.tokens import CELL, HASHED, MEAN, RECON, UNIFORM, R, cells, reconstruction, uniformity

P = with_(PAIR)
SCALE, ALPHA, U_WEIGHT, R_WEIGHT, BETA, BATCH, TAU = 20.0, 0.5, 0.01, 0.1, 0.5, 32, 0.5


def scored(spark, sf):
    """(q, c, score, same): all pairs; same: equal labels."""
    left, right = pairs(spark, sf)
    s = maxsim.scores(left.select("q", "tokens"), right.select("c", "tokens"))
    return s.join(left.select("q", F.col("g").alias("qg")), "q").join(right.select("c", F.col("g").alias("cg")), "c").select("q", "c", "score", (F.col("qg") == F.col("cg")).alias("same"))


def diagonal(spark, sf):
    """(q, g, pos): each pair's own score, inside the JVM, without other pairs."""
    left, right = pairs(spark, sf)
    both = left.join(right.select(F.col("c").alias("q"), F.col("tokens").alias("other")), "q")
    return both.select("q", "g", F.round(maxsim.nested(F.col("tokens"), F.col("other")), 9).alias("pos"))


@query(P + f"SELECT q, c, round(score, 9) AS score FROM scores")
def maxsim_matrix(spark, sf):
    left, right = pairs(spark, sf)
    s = maxsim.scores(left.select("q", "tokens"), right.select("c", "tokens"))  # of 9 decimals already
    return s.select("q", "c", (F.col("score") + F.lit(0.0)).alias("score"))


def own_candidates(spark, sf):
    """(q, j, c, score, g): four candidates of each query, joined by key."""
    left, right = pairs(spark, sf)
    n = left.agg(F.count("*").alias("n"))
    asked = left.crossJoin(F.broadcast(n)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("c", (F.col("q") + F.col("j") * 37) % F.col("n"))
    both = asked.join(right.select("c", F.col("tokens").alias("other")), "c")
    return both.select("q", "j", "c", "g", F.round(maxsim.nested(F.col("tokens"), F.col("other")), 9).alias("score"))


CAND = "cand AS (SELECT s.q, CAST(j AS INTEGER) AS j, s.c, s.qg, score FROM scores s JOIN (SELECT q, j, (q + j * 37) % n AS c FROM (SELECT DISTINCT q FROM lt) CROSS JOIN range(4) t(j) CROSS JOIN (SELECT count(DISTINCT q) AS n FROM lt)) k ON k.q = s.q AND k.c = s.c)"


@query(with_(PAIR, CAND) + f"SELECT q, j, c, round(score, 9) AS score FROM cand")
def maxsim_paired(spark, sf):
    return own_candidates(spark, sf).select("q", "j", "c", rounded(F.col("score"), 9).alias("score"))


@query(P + f"SELECT q, round(greatest(-1.0, least(1.0, score)), 9) AS score FROM scores WHERE q = c")
def pair_maxsim_clamped(spark, sf):
    return diagonal(spark, sf).select("q", rounded(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pos"))), 9).alias("score"))


@query(P + f"SELECT q, c, round(score, 9) AS score FROM scores WHERE q // 16 = c // 16")
def grouped_maxsim(spark, sf):
    left, right = pairs(spark, sf)
    both = left.withColumn("b", F.expr("q div 16")).join(right.select(F.expr("c div 16").alias("b"), "c", F.col("tokens").alias("other")), "b")
    return both.select("q", "c", rounded(F.round(maxsim.nested(F.col("tokens"), F.col("other")), 9), 9).alias("score"))


@query(P + f"SELECT {R('avg(score)')} AS positive FROM scores WHERE q = c")
def positive_score(spark, sf):
    return diagonal(spark, sf).agg(rounded(F.avg("pos")).alias("positive"))


RANKS = """best AS (SELECT q, max(score) FILTER (WHERE q = c) AS pos, max(score) FILTER (WHERE qg = cg OR q = c) AS best FROM scores GROUP BY q),
ranks AS (SELECT s.q, any_value(pos) AS pos, any_value(best) AS best_pos, count(*) FILTER (WHERE score >= pos) AS ungrouped, count(*) FILTER (WHERE NOT (qg = cg OR s.q = c) AND score > best) + 1 AS grouped FROM scores s JOIN best b ON s.q = b.q GROUP BY s.q)"""
BACK = """best2 AS (SELECT c, max(score) FILTER (WHERE q = c) AS pos, max(score) FILTER (WHERE qg = cg OR q = c) AS best FROM scores GROUP BY c),
back AS (SELECT s.c AS q, count(*) FILTER (WHERE score >= pos) AS ungrouped, count(*) FILTER (WHERE NOT (qg = cg OR q = s.c) AND score > best) + 1 AS grouped FROM scores s JOIN best2 b ON s.c = b.c GROUP BY s.c)"""


def forward(spark, sf, rule, relevant=None):
    return ranking.ranks(*pairs(spark, sf), relevant, (rule,))


@query(with_(PAIR, RANKS) + "SELECT q, ungrouped AS rank FROM ranks")
def rank_ungrouped(spark, sf):
    return forward(spark, sf, "ungrouped").select("q", F.col("ungrouped").alias("rank"))


@query(with_(PAIR, RANKS) + f"SELECT q, grouped AS rank, round(best_pos, 9) AS best_pos FROM ranks")
def rank_grouped(spark, sf):
    return forward(spark, sf, "grouped", "g").select("q", F.col("grouped").alias("rank"), rounded(F.col("best_pos"), 9).alias("best_pos"))


RK = ", ".join(f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS r{k}" for k in (1, 5, 10))
LONG = "long_ranks AS (SELECT 'forward' AS direction, rule, CASE rule WHEN 'ungrouped' THEN ungrouped ELSE grouped END AS rank FROM ranks CROSS JOIN (VALUES ('ungrouped'), ('grouped')) r(rule) UNION ALL SELECT 'backward', rule, CASE rule WHEN 'ungrouped' THEN ungrouped ELSE grouped END FROM back CROSS JOIN (VALUES ('ungrouped'), ('grouped')) r(rule))"


RECALL = f", per AS (SELECT direction, rule, {RK} FROM long_ranks GROUP BY direction, rule) SELECT direction, rule, {R('r1')} AS r1, {R('r5')} AS r5, {R('r10')} AS r10 FROM (SELECT * FROM per UNION ALL SELECT 'mean', rule, avg(r1), avg(r5), avg(r10) FROM per GROUP BY rule)"


@query(with_(PAIR, RANKS, BACK, LONG) + RECALL)
def retrieval_recall(spark, sf):
    """Recall at 1, 5 and 10 both ways and their mean, under both tie rules."""
    r = ranking.both_ranks(*pairs(spark, sf), "g")
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.col(x).alias("rank")) for x in ("ungrouped", "grouped")))).alias("x")
    long = r.select(F.when(F.col("side") == 0, "forward").otherwise("backward").alias("direction"), rules).select("direction", "x.*")
    per = long.groupBy("direction", "rule").agg(*(F.avg((F.col("rank") <= k).cast("double")).alias(f"r{k}") for k in (1, 5, 10)))
    per = settled(per)
    mean = per.groupBy("rule").agg(*(F.avg(f"r{k}").alias(f"r{k}") for k in (1, 5, 10))).select(F.lit("mean").alias("direction"), "rule", "r1", "r5", "r10")
    return per.union(mean).select("direction", "rule", *(rounded(F.col(f"r{k}")).alias(f"r{k}") for k in (1, 5, 10)))


AP = """placed AS (SELECT q, c, (qg = cg OR q = c) AS rel, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS r FROM scores),
ap AS (SELECT q, sum(h::DOUBLE / r) / greatest(count(*), 1) AS ap FROM (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY r) AS h FROM placed WHERE rel) GROUP BY q)"""


def average_precisions(spark, sf):
    left, right = pairs(spark, sf)
    return ranking.average_precisions(left, right, "g")


@query(with_(PAIR, AP) + f"SELECT q, {R('ap')} AS ap, {R('avg(ap) OVER ()')} AS map FROM ap")
def mean_average_precision(spark, sf):
    ap = settled(average_precisions(spark, sf))
    return ap.crossJoin(F.broadcast(ap.agg(F.avg("ap").alias("m")))).select("q", rounded(F.col("ap")).alias("ap"), rounded(F.col("m")).alias("map"))


@query(with_(PAIR, RANKS, AP) + f"SELECT count(*) AS n, {', '.join(f'CASE WHEN count(*) >= {k} THEN round(avg(CASE WHEN grouped <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) END AS r{k}' for k in (1, 5, 10, 1000000))}, {R('(SELECT avg(ap) FROM ap)')} AS map, CAST(quantile_disc(grouped, 0.5) AS BIGINT) AS median_rank, {R('avg(best_pos)')} AS best_pos FROM ranks")
def grouped_recall(spark, sf):
    """Recall only for k up to the number of queries, mean average precision, the lower median rank, the mean best positive score."""
    left, right = pairs(spark, sf)
    ks = (1, 5, 10, 1000000)
    m = ranking.measures(left, right, "g", ks)
    return m.select("n", "median_rank", *(rounded(F.col(c)).alias(c) for c in (*(f"r{k}" for k in ks), "map", "best_pos")))


@query(P + "SELECT q, count(*) FILTER (WHERE q <> c AND (qg = cg OR q // 3 = c // 3)) AS n_masked, count(*) FILTER (WHERE q = c OR NOT (qg = cg OR q // 3 = c // 3)) AS n_kept FROM scores GROUP BY q")
def false_negative_mask(spark, sf):
    """Columns that a query must not be told apart from: equal label or equal group, directly, not by a chain.  Counted by key, without pairs."""
    left, right = pairs(spark, sf)
    l, r = left.select("q", "g", F.expr("q div 3").alias("t")), right.select("c", "g", F.expr("c div 3").alias("t"))
    by = lambda keys, name: r.groupBy(*keys).agg(F.count("*").alias(name))
    n = r.agg(F.count("*").alias("n"))
    out = l.join(by(["g"], "a"), "g", "left").join(by(["t"], "b"), "t", "left").join(by(["g", "t"], "ab"), ["g", "t"], "left").crossJoin(F.broadcast(n))
    masked = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) - F.coalesce("ab", F.lit(0)) - 1
    return out.select("q", masked.cast("long").alias("n_masked"), (F.col("n") - masked).cast("long").alias("n_kept"))


NCE = f"""logits AS (SELECT q, c, CASE WHEN q <> c AND qg = cg THEN -10000.0 ELSE {SCALE} * score END AS x FROM scores),
rows_ AS (SELECT q, max(x) + ln(sum(exp(x - m))) - max(x) FILTER (WHERE q = c) AS loss, arg_max(c, (x, -c)) = q AS hit FROM (SELECT *, max(x) OVER (PARTITION BY q) AS m FROM logits) GROUP BY q),
cols_ AS (SELECT c, max(x) + ln(sum(exp(x - m))) - max(x) FILTER (WHERE q = c) AS loss FROM (SELECT *, max(x) OVER (PARTITION BY c) AS m FROM logits) GROUP BY c),
nce AS (SELECT (SELECT avg(loss) FROM rows_) AS forward, (SELECT avg(loss) FROM cols_) AS backward, (SELECT avg(hit::INT::DOUBLE) FROM rows_) AS acc1)"""


def nce(spark, sf):
    """(forward, backward, acc1).  Scores are at most 1 for unit tokens, so a log sum needs no pass for its maximum: each block of pairs
    gives one partial sum a query and one a candidate, and no pair is kept."""
    left, right = pairs(spark, sf)

    def sums(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        q, c = x.q.to_numpy(), y.c.to_numpy()
        own = q[:, None] == c[None, :]
        logits = s * SCALE
        logits[maxsim.matches(x.g, y.g) & ~own] = -1e4
        most, best = logits.max(1), c[logits.argmax(1)]  # of equal scores the smallest candidate: c ascends
        mine = np.where(own, logits, -np.inf) if own.any() else np.full((1, 1), -np.inf)
        each = np.exp(np.subtract(logits, SCALE, out=logits), out=logits)
        rows = pd.DataFrame({"side": 0, "id": q, "total": each.sum(1), "own": np.broadcast_to(mine.max(1), len(q)), "most": most, "best": best})
        return pd.concat([rows, pd.DataFrame({"side": 1, "id": c, "total": each.sum(0), "own": np.broadcast_to(mine.max(0), len(c)), "most": 0.0, "best": 0})])

    parts = maxsim.all_pairs(left, right, sums, "side long, id long, total double, own double, most double, best long")
    each = parts.groupBy("side", "id").agg(F.sum("total").alias("total"), F.max("own").alias("own"), F.max_by("best", F.struct("most", -F.col("best"))).alias("best"))
    loss = F.log("total") + SCALE - F.col("own")
    at = lambda side: F.avg(F.when(F.col("side") == side, loss))
    return each.agg(at(0).alias("forward"), at(1).alias("backward"), F.avg(F.when(F.col("side") == 0, (F.col("best") == F.col("id")).cast("double"))).alias("acc1"))


@query(with_(PAIR, NCE) + f"SELECT {R('forward')} AS forward, {R('backward')} AS backward, {R('(forward + backward) / 2')} AS loss, {R('acc1')} AS acc1 FROM nce")
def info_nce(spark, sf):
    n = nce(spark, sf)
    return n.select(rounded(F.col("forward")).alias("forward"), rounded(F.col("backward")).alias("backward"), rounded((F.col("forward") + F.col("backward")) / 2).alias("loss"), rounded(F.col("acc1")).alias("acc1"))


@query(
    with_(PAIR, NCE, MEAN, HASHED, UNIFORM, RECON)
    + f", parts AS (SELECT (SELECT avg(score) FROM scores WHERE q = c) AS pos, (SELECT avg(u) FROM uniform) AS u, (SELECT avg(mse) FROM recon) AS m, (SELECT (forward + backward) / 2 FROM nce) AS nce) SELECT {R(f'(1 - pos) + {U_WEIGHT} * u + {R_WEIGHT} * m')} AS first_phase, {R(f'nce + {ALPHA} * (1 - pos) + {R_WEIGHT} * m + {U_WEIGHT} * u')} AS second_phase FROM parts"
)
def phase_loss(spark, sf):
    one = diagonal(spark, sf).agg(F.avg("pos").alias("pos"))
    one = one.crossJoin(uniformity(spark, sf).agg(F.avg("u").alias("u"))).crossJoin(reconstruction(spark, sf).agg(F.avg("mse").alias("m")))
    one = one.crossJoin(nce(spark, sf).select(((F.col("forward") + F.col("backward")) / 2).alias("nce")))
    first = (1 - F.col("pos")) + U_WEIGHT * F.col("u") + R_WEIGHT * F.col("m")
    return one.select(rounded(first).alias("first_phase"), rounded(F.col("nce") + ALPHA * (1 - F.col("pos")) + R_WEIGHT * F.col("m") + U_WEIGHT * F.col("u")).alias("second_phase"))


@query(with_(PAIR) + f"SELECT q, b * {BATCH} + (q - b * {BATCH} + size - 1) % size AS rolled FROM (SELECT q, q // {BATCH} AS b, count(*) OVER (PARTITION BY q // {BATCH}) AS size FROM (SELECT DISTINCT q FROM lt))")
def rolled_pairs(spark, sf):
    """Each row of a batch paired with the one before it, the first with the last."""
    left, _ = pairs(spark, sf)
    l = left.select("q", F.expr(f"q div {BATCH}").alias("b"))
    sized = l.join(l.groupBy("b").agg(F.count("*").alias("size")), "b")
    start = F.col("b") * BATCH
    return sized.select("q", (start + F.pmod(F.col("q") - start - 1, F.col("size"))).alias("rolled"))


PANEL = f"panel AS (SELECT q AS pq FROM (SELECT DISTINCT q FROM lt) ORDER BY {sql_hash('11', 'q')}, q LIMIT 8)"
MARGIN = "margins AS (SELECT k.q, k.j, k.c, k.score, k.score - max(s.score) AS margin FROM cand k JOIN scores s ON s.c = k.c JOIN panel p ON s.q = p.pq GROUP BY k.q, k.j, k.c, k.score)"


def margins(spark, sf):
    """(q, j, c, score, margin): each candidate's score less its best against a panel of 8 sampled queries."""
    left, right = pairs(spark, sf)
    panel = splits.hash_sample(left.select("q", "tokens"), "q", 11, 8)
    worst = maxsim.scores(panel, right.select("c", "tokens")).groupBy("c").agg(F.max("score").alias("panel"))
    return own_candidates(spark, sf).join(worst, "c").select("q", "j", "c", "score", (F.col("score") - F.col("panel")).alias("margin"))


@query(with_(PAIR, CAND, PANEL, MARGIN) + f"SELECT q, arg_max(c, (round(margin, 9), -j)) AS best, round(max(margin), 9) AS margin FROM margins GROUP BY q")
def best_of_n_margin(spark, sf):
    best = margins(spark, sf).groupBy("q").agg(F.max_by("c", F.struct(F.round("margin", 9), -F.col("j"))).alias("best"), F.max("margin").alias("margin"))
    return best.select("q", "best", rounded(F.col("margin"), 9).alias("margin"))


@query(with_(PAIR, CAND) + f"SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, j) AS BIGINT) AS rank, j, round(score, 9) AS score FROM cand")
def best_of_n_ranking(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "j", "score")))
    each = own_candidates(spark, sf).groupBy("q").agg(ordered.alias("t")).select("q", F.posexplode("t").alias("p", "x"))
    return each.select("q", (F.col("p") + 1).cast("long").alias("rank"), F.col("x.j").alias("j"), rounded(F.col("x.score"), 9).alias("score"))


@query(P + f"SELECT q, round(pos - {BETA} * coalesce(other, -1), 12) AS reward FROM (SELECT q, max(score) FILTER (WHERE q = c) AS pos, max(score) FILTER (WHERE qg <> cg) AS other FROM scores WHERE q // {BATCH} = c // {BATCH} GROUP BY q)")
def contrastive_reward(spark, sf):
    """Own score less a share of the best score of another label in the batch; -1 stands in where all are blocked."""
    left, right = pairs(spark, sf)
    both = left.withColumn("b", F.expr(f"q div {BATCH}")).join(right.select(F.expr(f"c div {BATCH}").alias("b"), "c", F.col("tokens").alias("other"), F.col("g").alias("cg")), "b")
    s = both.select("q", "c", "g", "cg", F.round(maxsim.nested(F.col("tokens"), F.col("other")), 9).alias("s"))
    by = s.groupBy("q").agg(F.max(F.when(F.col("q") == F.col("c"), F.col("s"))).alias("pos"), F.max(F.when(F.col("g") != F.col("cg"), F.col("s"))).alias("other"))
    return by.select("q", rounded(F.col("pos") - BETA * F.coalesce("other", F.lit(-1.0)), 12).alias("reward"))


@query(with_(PAIR, CAND) + f"SELECT q, j, {R('(score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-4)')} AS advantage FROM cand WINDOW w AS (PARTITION BY q)")
def group_advantage(spark, sf):
    w = Window.partitionBy("q")
    c = own_candidates(spark, sf)
    return c.select("q", "j", rounded((F.col("score") - F.avg("score").over(w)) / (F.stddev_samp("score").over(w) + 1e-4)).alias("advantage"))


ATTN = CELL + ", attn AS (SELECT k, i, j, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS a FROM cell WINDOW w AS (PARTITION BY k, i))"


def attention(spark, sf):
    w = Window.partitionBy("k", "i")
    m = cells(spark, sf).withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return m.select("k", "i", "j", (F.col("e") / F.sum("e").over(w)).alias("a"))


@query(with_(ATTN) + f"SELECT k, i, j, {R('a')} AS weight FROM attn")
def attention_softmax(spark, sf):
    return attention(spark, sf).select("k", "i", "j", rounded(F.col("a")).alias("weight"))


COV = ATTN + ", cov AS (SELECT k, j, max(a) AS cov FROM attn GROUP BY k, j)"


@query(with_(COV) + f"SELECT k, {R(f'avg(power(greatest(0, {TAU} - cov) / {TAU}, 2))')} AS penalty FROM cov GROUP BY k")
def coverage_penalty(spark, sf):
    cov = attention(spark, sf).groupBy("k", "j").agg(F.max("a").alias("cov"))
    return cov.groupBy("k").agg(rounded(F.avg(F.pow(F.greatest(F.lit(0.0), TAU - F.col("cov")) / TAU, F.lit(2.0)))).alias("penalty"))


BELOW = [0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5]


@query(with_(COV) + "SELECT " + ", ".join(f"{R(f'avg(CASE WHEN cov < {t} THEN 1.0::DOUBLE ELSE 0 END)')} AS below_{n}" for n, t in enumerate(BELOW)) + ", " + ", ".join(f"{R(f'quantile_cont(cov, {p})')} AS p{int(100 * p)}" for p in (0.1, 0.5, 0.9)) + f", {R('avg(1.0::DOUBLE / 4)')} AS mean_inverse_length FROM cov")
def coverage_profile(spark, sf):
    cov = settled(attention(spark, sf).groupBy("k", "j").agg(F.max("a").alias("cov")), "coverage")
    below = [rounded(F.avg((F.col("cov") < t).cast("double"))).alias(f"below_{n}") for n, t in enumerate(BELOW)]
    shares = (0.1, 0.5, 0.9)
    at = [rounded(F.lit(x).cast("double")).alias(f"p{int(100 * p)}") for p, x in zip(shares, quantiles(cov, "cov", list(shares)), strict=True)]
    return cov.agg(*below, *at, rounded(F.avg(F.lit(0.25))).alias("mean_inverse_length"))


KEYS = ", ".join(f"'\"r{k}\":', CAST(r{k} AS VARCHAR){sep}" for k, sep in ((1, ", ','"), (5, ", ','"), (10, "")))
ENTRY = f"concat('\"', direction, '_', rule, '\":{{', {KEYS}, '}}')"


@query(f"SELECT concat('{{\"recall\":{{', string_agg({ENTRY}, ',' ORDER BY direction, rule), '}},\"config\":{{\"score\":\"maxsim\"}}}}') AS json FROM ({with_(PAIR, RANKS, BACK, LONG) + RECALL})")
def metrics_json(spark, sf):
    """One row of nested measures as JSON."""
    r = retrieval_recall(spark, sf)
    fields = F.concat_ws(",", *(F.concat(F.lit(f'"r{k}":'), number_text(F.col(f"r{k}"))) for k in (1, 5, 10)))
    each = F.concat(F.lit('"'), F.col("direction"), F.lit("_"), F.col("rule"), F.lit('":{'), fields, F.lit("}"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("direction", "rule", each.alias("x")))), lambda e: e["x"])
    return r.agg(F.concat(F.lit('{"recall":{'), F.concat_ws(",", entries), F.lit('},"config":{"score":"maxsim"}}')).alias("json"))
