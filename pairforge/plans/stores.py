"""Queries over what surrounds a store: dimension tables, fingerprints, references, vocabulary, rounding, probes, round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairforge.functions.scalar import bf16
from pairforge.functions.shared import positions, rounded, shared_base, sql_hash
from pairforge.operators import geometry, roundtrip, stores
from pairforge.plans.base import DOC, PAIR, TOK, doc, events, pairs, query, table, tok, with_
from pairforge.plans.retrieval import AP, BACK, CAND, MARGIN, PANEL, RANKS, margins
from pairforge.plans.tokens import SIDE, R, side

D = with_(DOC)


def merged(spark, sf):
    """The folder of a store's tables, written as `merge` does."""
    path = f"{shared_base(spark)}/store-{uuid.uuid4().hex}"
    stores.merge(doc(spark, sf), path)
    return path


ITEMS = "dims AS (SELECT row_number() OVER (ORDER BY min(row_idx)) - 1 AS item_id, protein, arg_min(uid, row_idx) AS uid FROM doc GROUP BY protein)"


@query(with_(DOC, ITEMS) + "SELECT item_id, protein, uid FROM dims")
def store_items(spark, sf):
    return spark.read.parquet(merged(spark, sf) + "/items").select("item_id", "protein", "uid")


@query(with_(DOC, ITEMS) + "SELECT row_idx, item_id FROM doc JOIN dims USING (protein)")
def store_row_map(spark, sf):
    return spark.read.parquet(merged(spark, sf) + "/row_map").select("row_idx", "item_id")


@query(D + "SELECT row_idx, text_gid FROM doc JOIN (SELECT row_number() OVER (ORDER BY min(row_idx)) - 1 AS text_gid, text FROM doc GROUP BY text) USING (text)")
def store_caption_ids(spark, sf):
    return spark.read.parquet(merged(spark, sf) + "/caption_ids").select("row_idx", "text_gid")


@query(D + "SELECT count(*) AS rows, count(DISTINCT uid) AS uids, count(DISTINCT protein) AS items, count(DISTINCT text) AS captions, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(row_idx AS VARCHAR), uid, protein, text)), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest, '{}' AS settings FROM doc")
def store_fingerprint(spark, sf):
    return spark.read.schema(stores.FINGERPRINT).json(merged(spark, sf) + "/fingerprint")


@query("WITH r AS (SELECT CASE WHEN user_id % 10 <> 0 THEN user_id * 20 END AS k FROM events) SELECT (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM customer) AS items, (SELECT count(*) FROM r WHERE k NOT IN (SELECT c_custkey FROM customer)) AS dangling, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM r WHERE k IS NOT NULL)) AS unused, (SELECT count(*) FROM r WHERE k IS NULL) AS nulls")
def reference_check(spark, sf):
    """What a reader of two tables checks before it joins them, on keys of which some are null and some name nothing."""
    keys = table(spark, sf, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id") * 20).alias("k"))
    return stores.references(keys, "k", table(spark, sf, "customer"), "c_custkey")


EXPONENT = "pow(2.0::DOUBLE, floor(log2(abs(x))) - 7)"


@query(f"SELECT vec_id, CAST(k AS INTEGER) AS pos, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / {EXPONENT}, 0) * {EXPONENT} END AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")
def bf16_round(spark, sf):
    """Eight significant bits of each component, ties to even."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", "pos", bf16(F.col("x").cast("float")).cast("double").alias("x"))


NAMES = ["end", "start", "pad", "mask", "A"]


def vocabulary(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "id long, token string")


@query("SELECT event_id, event_id % 7 AS token_id, CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " ELSE '<' || (event_id % 7) || '>' END AS token FROM events")
def token_names(spark, sf):
    ids = table(spark, sf, "events").select("event_id", (F.col("event_id") % 7).cast("long").alias("token_id"))
    return stores.token_names(ids, vocabulary(spark)).select("event_id", "token_id", "token")


WORDS = "words AS (SELECT w AS token, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part))"
NEW = "new AS (SELECT label, row_number() OVER (ORDER BY first) - 1 AS k FROM (SELECT upper(p_brand) || ':' AS label, min(p_partkey) AS first FROM part GROUP BY 1) WHERE label NOT IN (SELECT token FROM words))"


@query(with_(WORDS, NEW) + "SELECT id, token FROM words UNION ALL SELECT (SELECT max(id) FROM words) + 1 + k, label FROM new")
def label_tokens(spark, sf):
    """The parts' words as a vocabulary, and their brands as field labels: those that it lacks follow its last id in the order in which they appear."""
    p = table(spark, sf, "part")
    words = positions(p.select(F.explode(F.split("p_name", " ")).alias("token")).distinct(), ["token"], name="id")
    labels = p.groupBy(F.concat(F.upper("p_brand"), F.lit(":")).alias("label")).agg(F.min("p_partkey").alias("first"))
    return stores.with_labels(words, labels, "first")


@query("SELECT CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS seq, count(*) AS n, TRUE AS same_length, TRUE AS known_tokens, TRUE AS within_share FROM events GROUP BY 1")
def span_corruption_bounds(spark, sf):
    """What holds for every corrupted sequence: its length, changed tokens are of the alphabet, and at most the share asked for is changed."""
    from pairforge.plans.sequences import span_corruption

    c = span_corruption(spark, sf)
    changed = F.size(F.filter(F.zip_with("t", "corrupted", lambda a, b: a != b), lambda x: x))
    known = F.forall(F.zip_with("t", "corrupted", lambda a, b: (a == b) | b.isin("click", "login", "purchase", "signup", "view")), lambda x: x)
    return c.select("seq", F.size("t").cast("long").alias("n"), (F.size("t") == F.size("corrupted")).alias("same_length"), known.alias("known_tokens"), (changed <= F.greatest(F.lit(1), F.ceil(0.3 * F.size("t")))).alias("within_share"))


PROBE, EACH = 64, 2


@query(
    with_(TOK)
    + f""", probe AS (SELECT vec_id, side FROM (SELECT vec_id, {SIDE} AS side, {sql_hash('3', 'vec_id')} AS h FROM embeddings) QUALIFY row_number() OVER (PARTITION BY side ORDER BY h, vec_id) <= {PROBE}),
pt AS (SELECT side, t.vec_id, t.pos, t.r, t.v, row_number() OVER (PARTITION BY t.vec_id ORDER BY {sql_hash('3', 't.vec_id', 't.pos')}, t.pos) AS k FROM tok t JOIN probe p ON p.vec_id = t.vec_id),
inside AS (SELECT side, count(*) AS sequences, avg(w) AS w FROM (SELECT a.side, a.vec_id, avg(list_dot_product(a.v, b.v)) AS w FROM pt a JOIN pt b ON a.vec_id = b.vec_id AND a.pos <> b.pos GROUP BY 1, 2) GROUP BY side),
pool AS (SELECT side, vec_id * 4 + pos AS id, r, v FROM pt WHERE k <= {EACH}),
mu AS (SELECT side, list(m ORDER BY d) AS m FROM (SELECT side, d, avg(x) AS m FROM (SELECT side, CAST(unnest(range(16)) AS INTEGER) AS d, unnest(r) AS x FROM pool) GROUP BY side, d) GROUP BY side),
cen AS (SELECT side, id, v, m, list_transform(list_zip(r, m), lambda x: x[1] - x[2]) AS c FROM pool JOIN mu USING (side)),
toward AS (SELECT side, avg(abs(list_dot_product(v, m)) / sqrt(list_dot_product(m, m))) AS t FROM cen GROUP BY side),
crossed AS (SELECT a.side, avg(list_dot_product(a.v, b.v)) AS raw, avg(list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c)) / sqrt(list_dot_product(b.c, b.c))) AS centered FROM cen a JOIN cen b ON a.side = b.side AND a.id <> b.id GROUP BY a.side)
SELECT side, sequences, {R('w')} AS within, {R('raw')} AS raw, {R('t')} AS to_mean, {R('centered')} AS centered FROM inside JOIN toward USING (side) JOIN crossed USING (side)"""
)
def spread_report(spark, sf):
    tokens = tok(spark, sf).select(side().alias("side"), F.col("vec_id").alias("item_id"), "pos", F.col("r").alias("v"))
    r = geometry.spread_report(tokens, PROBE, EACH)
    return r.select("side", "sequences", *(rounded(F.col(c)).alias(c) for c in ("within", "raw", "to_mean", "centered")))


def records(spark, sf):
    """Round trips: sources are the left sides, generated targets the right ones; the true targets hold the same tokens in reverse."""
    left, right = pairs(spark, sf)
    both = left.select(F.col("q").alias("row_idx"), "g", F.col("tokens").alias("z_src")).join(right.select(F.col("c").alias("row_idx"), F.col("tokens").alias("z_gen")), "row_idx")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("true_target"), F.concat("lang", F.lit(" \t"), "source").alias("gen_target"))
    texts = (F.coalesce(c, F.lit("")).alias(c) for c in ("true_target", "gen_target"))
    return both.join(d, "row_idx", "left").select("row_idx", F.col("g").cast("string").alias("uid"), "z_src", "z_gen", F.reverse("z_gen").alias("z_true"), *texts)


BACK_AP = """placed2 AS (SELECT c, (qg = cg OR q = c) AS rel, row_number() OVER (PARTITION BY c ORDER BY score DESC, q) AS r FROM scores),
ap2 AS (SELECT c, sum(h::DOUBLE / r) / greatest(count(*), 1) AS ap FROM (SELECT c, r, row_number() OVER (PARTITION BY c ORDER BY r) AS h FROM placed2 WHERE rel) GROUP BY c)"""
MEASURES = "SELECT '{}' AS comparison, count(*) AS n, " + ", ".join(f"CASE WHEN count(*) >= {k} THEN {R(f'avg(CASE WHEN grouped <= {k} THEN 1.0::DOUBLE ELSE 0 END)')} END AS r{k}" for k in (1, 5, 10)) + f", {R('(SELECT avg(ap) FROM {})')} AS map, CAST(quantile_disc(grouped, 0.5) AS BIGINT) AS median_rank, {R('(SELECT avg(best) FROM {})')} AS best_pos FROM {{}}"


@query(with_(PAIR, RANKS, BACK, AP, BACK_AP) + " UNION ALL ".join(MEASURES.format(*x) for x in (("source_to_generated", "ap", "best", "ranks"), ("generated_to_source", "ap2", "best2", "back"), ("true_to_source", "ap2", "best2", "back"))))
def roundtrip_measures(spark, sf):
    m = roundtrip.measures(records(spark, sf))
    return m.select("comparison", "n", "median_rank", *(rounded(F.col(c)).alias(c) for c in ("r1", "r5", "r10", "map", "best_pos")))


@query(with_(PAIR, BACK) + "SELECT b.q AS row_idx, CAST(s.qg AS VARCHAR) AS id, b.grouped AS rank, printf('%.4f', s.score) AS score, CAST(length(t) AS INTEGER) AS true_len, CAST(length(m) AS INTEGER) AS gen_len, t AS true_target, m AS generated_target FROM back b JOIN scores s ON s.q = b.q AND s.c = b.q JOIN (SELECT q, coalesce(source, '') AS t, coalesce(lang || ' ' || source, '') AS m FROM back LEFT JOIN documents ON doc_id = q) x ON x.q = b.q")
def roundtrip_pairs(spark, sf):
    return roundtrip.pairs(records(spark, sf))


@query(
    with_(PAIR, CAND, PANEL, MARGIN)
    + """, won AS (SELECT q, j // 2 AS replicate, arg_max(c, (round(margin, 9), -j)) AS c, round(max(margin), 9) AS margin FROM margins JOIN documents ON doc_id = c GROUP BY 1, 2)
SELECT CAST(q AS VARCHAR) AS accession, CAST(replicate AS INTEGER) AS replicate, d.source AS prompt, d.lang AS true_protein, e.lang || e.source AS generated_protein, printf('%.4f', margin) AS select_score, CAST(length(d.lang) AS INTEGER) AS true_len, CAST(length(e.lang || e.source) AS INTEGER) AS gen_len FROM won JOIN documents d ON d.doc_id = q JOIN documents e ON e.doc_id = c"""
)
def generated_set(spark, sf):
    """Two replicates of two candidates each, the one kept that stands out most from the panel."""
    d = table(spark, sf, "documents")
    m = margins(spark, sf).select("q", "j", "c", F.round("margin", 9).alias("score"), F.expr("cast(j div 2 as int)").alias("replicate"))
    m = m.join(d.select(F.col("doc_id").alias("q"), F.col("source").alias("prompt"), F.col("lang").alias("true_protein")), "q")
    m = m.join(d.select(F.col("doc_id").alias("c"), F.concat("lang", "source").alias("generated_protein")), "c")
    return roundtrip.generated_set(m.withColumn("accession", F.col("q").cast("string")))
