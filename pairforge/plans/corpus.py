"""Queries over the pair table: scans, identity, splits, pools, shards, token rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairforge.functions.shared import keyed_hash, positions, sql_hash
from pairforge.operators import identity, splits
from pairforge.plans.base import DOC, doc, query, table, with_

SEED, RATIOS, WORLD = 13, (0.8, 0.1), 7
D = with_(DOC)


@query(D + "SELECT row_idx, uid, coalesce(protein, '') AS protein, coalesce(text, '') AS text FROM doc")
def scan_pairs(spark, sf):
    return doc(spark, sf).select("row_idx", "uid", F.coalesce("protein", F.lit("")).alias("protein"), F.coalesce("text", F.lit("")).alias("text"))


@query(D + "SELECT row_idx, uid, text FROM doc")
def scan_captions(spark, sf):
    return doc(spark, sf).select("row_idx", "uid", "text")


def wanted(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), (F.col("item_id") * 10).cast("string").alias("uid"))


WANTED = "wanted AS (SELECT item_id AS ord, CAST(item_id * 10 AS VARCHAR) AS uid FROM benchmark)"


@query(with_(DOC, WANTED) + "SELECT w.ord, w.uid, min(d.row_idx) AS row_idx, arg_min(d.text, d.row_idx) AS text FROM wanted w JOIN doc d USING (uid) GROUP BY ALL")
def lookup_first_match(spark, sf):
    w = wanted(spark, sf)
    found = identity.first_rows(doc(spark, sf).join(w.select("uid").distinct(), "uid", "left_semi"), "uid", "row_idx", ["text"])
    return w.join(found, "uid").select("ord", "uid", "row_idx", "text")


@query(with_(DOC, WANTED) + "SELECT ord, uid FROM wanted WHERE uid NOT IN (SELECT uid FROM doc)")
def lookup_missing(spark, sf):
    return wanted(spark, sf).join(doc(spark, sf), "uid", "left_anti").select("ord", "uid")


@query("SELECT row_number() OVER (ORDER BY min(doc_id)) - 1 AS ord, trim(source) AS id FROM documents WHERE trim(source) <> '' GROUP BY trim(source)")
def id_list(spark, sf):
    ids = table(spark, sf, "documents").select(F.trim("source").alias("id"), "doc_id").where("id <> ''")
    return identity.dense_ids(ids, "id", "doc_id", "ord").select("ord", "id")


@query(D + "SELECT row_idx, uid FROM doc WHERE row_idx < 256")
def prefix_limit(spark, sf):
    return doc(spark, sf).where("row_idx < 256").select("row_idx", "uid")


@query(D + "SELECT row_idx, dir AS direction, CASE dir WHEN 'p2t' THEN protein ELSE text END AS source, CASE dir WHEN 'p2t' THEN text ELSE protein END AS target FROM doc CROSS JOIN (VALUES ('p2t'), ('t2p')) d(dir)")
def directional_pairs(spark, sf):
    both = doc(spark, sf).withColumn("direction", F.explode(F.array(F.lit("p2t"), F.lit("t2p"))))
    forward = F.col("direction") == "p2t"
    return both.select("row_idx", "direction", F.when(forward, F.col("protein")).otherwise(F.col("text")).alias("source"), F.when(forward, F.col("text")).otherwise(F.col("protein")).alias("target"))


@query(D + "SELECT count(*) AS n_rows, count(DISTINCT uid) AS n_uids, count(DISTINCT text) AS n_texts, count(DISTINCT protein) AS n_proteins FROM doc")
def corpus_counts(spark, sf):
    # distinct by keyed partial aggregates of each column on its own; texts by their digest
    d = doc(spark, sf).select("uid", "protein", F.md5("text").alias("h"))
    one = lambda c, name: d.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("x")).agg(F.count("*").alias(name))
    return d.agg(F.count("*").alias("n_rows")).crossJoin(one("uid", "n_uids")).crossJoin(one("h", "n_texts")).crossJoin(one("protein", "n_proteins"))


GIDS = "gids AS (SELECT row_idx, dense_rank() OVER (ORDER BY fu) - 1 AS uid_gid, dense_rank() OVER (ORDER BY ft) - 1 AS text_gid FROM (SELECT row_idx, min(row_idx) OVER (PARTITION BY uid) AS fu, min(row_idx) OVER (PARTITION BY text) AS ft FROM doc))"


@query(with_(DOC, GIDS) + "SELECT * FROM gids")
def dense_group_ids(spark, sf):
    d = doc(spark, sf).select("row_idx", "uid", F.md5("text").alias("h"))
    u = identity.dense_ids(d, "uid", "row_idx", "uid_gid").select("uid", "uid_gid")
    t = identity.dense_ids(d, "h", "row_idx", "text_gid").select("h", "text_gid")
    return d.join(u, d.uid.eqNullSafe(u.uid)).join(t, d.h.eqNullSafe(t.h)).select("row_idx", "uid_gid", "text_gid")


@query(D + "SELECT uid, min(row_idx) AS row_idx, arg_min(protein, row_idx) AS protein FROM doc GROUP BY uid")
def dedup_first(spark, sf):
    return identity.first_rows(doc(spark, sf), "uid", "row_idx", ["protein"])


CC = """star AS (SELECT row_idx AS a, min(row_idx) OVER (PARTITION BY uid) AS b FROM doc UNION SELECT row_idx, min(row_idx) OVER (PARTITION BY text) FROM doc),
sym AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT row_idx AS n, row_idx AS r FROM doc UNION SELECT reach.n, sym.b FROM reach JOIN sym ON reach.r = sym.a),
comp AS (SELECT n AS row_idx, min(r) AS root FROM reach GROUP BY n)"""


def roots(spark, sf):
    d = doc(spark, sf).select("row_idx", "uid", F.md5("text").alias("h"))
    return identity.connected_components(d, "row_idx", ["uid", "h"])


@query(with_(DOC, CC, recursive=True) + "SELECT row_idx, root, dense_rank() OVER (ORDER BY root) - 1 AS component FROM comp")
def connected_components(spark, sf):
    r = roots(spark, sf)
    ids = identity.dense_ids(r, "root", "root", "component")
    return r.join(ids.select("root", "component"), "root").select("row_idx", "root", "component")


def split_sql(source: str, key: str) -> str:
    return f"""ordered AS (SELECT {key}, row_number() OVER (ORDER BY {sql_hash(str(SEED), key)}, {key}) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {source})),
parted AS (SELECT {key}, ord, CASE WHEN ord < round_even(n * {RATIOS[0]}::DOUBLE, 0) THEN 'train' WHEN ord < round_even(n * {RATIOS[0]}::DOUBLE, 0) + round_even(n * {RATIOS[1]}::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM ordered)"""


@query(with_(DOC, split_sql("doc", "row_idx")) + "SELECT row_idx, ord, split FROM parted")
def split_rows(spark, sf):
    return splits.split(doc(spark, sf), "row_idx", SEED, RATIOS)


@query(with_(DOC, CC, split_sql("comp", "root"), recursive=True) + "SELECT c.row_idx, c.root, p.split FROM comp c JOIN parted p USING (root)")
def split_groups(spark, sf):
    return splits.split_by_group(roots(spark, sf), "row_idx", "root", SEED, RATIOS)


SAVED = [("same", 0, SEED, 0.0, 0), ("rows", 1, SEED, 0.0, 0), ("seed", 0, SEED + 1, 0.0, 0), ("tiny", 0, SEED, 1e-12, 0), ("ratio", 0, SEED, 1e-3, 0), ("groups", 0, SEED, 0.0, 1), ("stale", 0, SEED, 0.0, None)]
SAVED_SQL = ", ".join(f"('{a}', {b}, {c}, {d!r}::DOUBLE, {'NULL::BIGINT' if e is None else e})" for a, b, c, d, e in SAVED)


@query(D + f"SELECT name, coalesce(n + dn = n AND seed = {SEED} AND abs(dr) <= 1e-9 AND g + dg = g, FALSE) AS valid FROM (SELECT count(*) AS n, count(DISTINCT uid) AS g FROM doc) CROSS JOIN (VALUES {SAVED_SQL}) s(name, dn, seed, dr, dg)")
def split_validity(spark, sf):
    """Saved split headers against the corpus: rows, seed, ratios within 1e-9, groups; a header without groups is stale."""
    now = doc(spark, sf).groupBy("uid").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("g"))
    saved = spark.createDataFrame(SAVED, "name string, dn long, seed long, dr double, dg long")
    both = saved.crossJoin(F.broadcast(now))
    same = (F.col("n") + F.col("dn") == F.col("n")) & (F.col("seed") == SEED) & (F.abs("dr") <= 1e-9) & (F.col("g") + F.col("dg") == F.col("g"))
    return both.select("name", F.coalesce(same, F.lit(False)).alias("valid"))


@query(with_(DOC, split_sql("doc", "row_idx")) + "SELECT split, uid, arg_min(row_idx, ord) AS row_idx FROM parted JOIN doc USING (row_idx) GROUP BY split, uid")
def split_dedup(spark, sf):
    s = splits.split(doc(spark, sf), "row_idx", SEED, RATIOS).join(doc(spark, sf).select("row_idx", "uid"), "row_idx")
    return s.groupBy("split", "uid").agg(F.min_by("row_idx", "ord").alias("row_idx"))


@query(with_(DOC, split_sql("doc", "row_idx")) + "SELECT DISTINCT uid FROM doc WHERE row_idx IN (SELECT row_idx FROM parted WHERE split = 'val')")
def split_proteins(spark, sf):
    val = splits.split(doc(spark, sf), "row_idx", SEED, RATIOS).where("split = 'val'")
    return doc(spark, sf).join(val, "row_idx", "left_semi").select("uid").distinct()


def top_sql(n: int, seed: int) -> str:
    return f"SELECT row_idx, uid, {sql_hash(str(seed), 'row_idx')} AS h FROM doc ORDER BY h, row_idx LIMIT {n}"


@query(D + f"SELECT row_idx, uid, pos, pos % 4 AS shard FROM (SELECT row_idx, uid, row_number() OVER (ORDER BY h, row_idx) - 1 AS pos FROM ({top_sql(100, 101)}))")
def eval_pool(spark, sf):
    pool = splits.hash_sample(doc(spark, sf).select("row_idx", "uid"), "row_idx", 101, 100)
    placed = positions(pool.withColumn("_h", keyed_hash(101, F.col("row_idx"))), ["_h", "row_idx"], name="pos")
    return placed.select("row_idx", "uid", "pos", F.pmod("pos", F.lit(4)).cast("long").alias("shard"))


@query(D + f"SELECT row_idx, uid FROM ({top_sql(64, 5)})")
def hash_sample(spark, sf):
    return splits.hash_sample(doc(spark, sf).select("row_idx", "uid"), "row_idx", 5, 64)


@query(with_(DOC, WANTED) + "SELECT row_idx, uid FROM doc WHERE uid NOT IN (SELECT uid FROM wanted) ORDER BY row_idx LIMIT 50")
def panel_exclude(spark, sf):
    rest = doc(spark, sf).select("row_idx", "uid").join(wanted(spark, sf), "uid", "left_anti")
    return rest.orderBy("row_idx").limit(50).select("row_idx", "uid")


SHARDS = f"shards AS (SELECT r AS rank, r * (n // {WORLD}) + least(r, n % {WORLD}) AS start, n // {WORLD} + CASE WHEN r < n % {WORLD} THEN 1 ELSE 0 END AS length FROM (SELECT count(*) AS n FROM doc) CROSS JOIN range({WORLD}) t(r))"


def shards(spark, sf):
    n = doc(spark, sf).agg(F.count("*").alias("n"))
    ranks = spark.range(WORLD).withColumnRenamed("id", "rank").crossJoin(F.broadcast(n))
    start, length = splits.shard_range(F.col("n"), WORLD, F.col("rank"))
    return ranks.select("rank", start.alias("start"), length.alias("length"), "n")


@query(with_(DOC, SHARDS) + "SELECT rank, start, length FROM shards")
def shard_ranges(spark, sf):
    return shards(spark, sf).drop("n")


@query(with_(DOC, SHARDS) + "SELECT bool_and(start = prev) AND max(start + length) = (SELECT count(*) FROM doc) AS tiles, count(*) AS shards, max(start + length) AS covered FROM (SELECT *, lag(start + length, 1, 0) OVER (ORDER BY start) AS prev FROM shards)")
def shard_tiling(spark, sf):
    return splits.tiling(shards(spark, sf), F.col("n"))


@query(with_(DOC, SHARDS) + f"SELECT run, count(DISTINCT world) = 1 AND count(world) = max(world) AS whole, count(world) AS stamped FROM (SELECT run, CASE WHEN run = 'old' AND rank = 2 THEN {WORLD + 1} WHEN run = 'bare' AND rank = 3 THEN NULL ELSE {WORLD} END AS world FROM shards CROSS JOIN (VALUES ('good'), ('old'), ('bare')) r(run)) GROUP BY run")
def shard_world_check(spark, sf):
    """Whether the shards of a run were all written by one world of that size; shards without a stamp are passed over."""
    s = shards(spark, sf).withColumn("run", F.explode(F.array(F.lit("good"), F.lit("old"), F.lit("bare"))))
    world = F.when((F.col("run") == "old") & (F.col("rank") == 2), WORLD + 1).when((F.col("run") == "bare") & (F.col("rank") == 3), None).otherwise(WORLD)
    s = s.withColumn("world", world)
    return s.groupBy("run").agg(((F.min("world") == F.max("world")) & (F.count("world") == F.max("world"))).alias("whole"), F.count("world").alias("stamped"))


@query(with_(DOC, SHARDS) + "SELECT row_idx, rank, row_number() OVER (ORDER BY start, row_idx) - 1 AS pos FROM doc JOIN shards ON row_idx >= start AND row_idx < start + length")
def ordered_union(spark, sf):
    # the shard of a row by arithmetic instead of a range join
    d = doc(spark, sf).select("row_idx").crossJoin(F.broadcast(doc(spark, sf).agg(F.count("*").alias("n"))))
    base, extra = F.floor(F.col("n") / WORLD), F.col("n") % WORLD
    wide = extra * (base + 1)
    rank = F.when(F.col("row_idx") < wide, F.floor(F.col("row_idx") / (base + 1))).otherwise(extra + F.floor((F.col("row_idx") - wide) / base)).cast("long")
    return positions(d.where("row_idx >= 0 and row_idx < n").select("row_idx", rank.alias("rank")), ["rank", "row_idx"], name="pos").select("row_idx", "rank", "pos")


@query(D + "SELECT row_idx, length(text) AS len, CAST(coalesce(sum(length(text)) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM doc")
def packed_offsets(spark, sf):
    d = doc(spark, sf).select("row_idx", F.length("text").cast("long").alias("len"))
    return positions(d, ["row_idx"], name="start", step=F.col("len")).select("row_idx", "len", "start")


@query(D + "SELECT row_idx, len(t) AS n_tokens, least(len(t), 64) AS n_kept, array_to_string(list_slice(t, 1, 64), ' ') AS kept FROM (SELECT row_idx, string_split(text, ' ') AS t FROM doc)")
def truncate_tokens(spark, sf):
    d = doc(spark, sf).select("row_idx", F.split("text", " ").alias("t"))
    return d.select("row_idx", F.size("t").cast("long").alias("n_tokens"), F.least(F.size("t"), F.lit(64)).cast("long").alias("n_kept"), F.array_join(F.slice("t", 1, 64), " ").alias("kept"))


SPECIALS, FIELD_LABELS = ["the", "of"], ["that", "to"]


@query(D + f"SELECT row_idx, len(t) AS n_all, len(list_filter(t, lambda x: x NOT IN {tuple(SPECIALS)!r})) AS n_without_specials, len(list_filter(t, lambda x: x NOT IN {tuple(SPECIALS + FIELD_LABELS)!r})) AS n_without_both FROM (SELECT row_idx, string_split(text, ' ') AS t FROM doc)")
def valid_token_filter(spark, sf):
    d = doc(spark, sf).select("row_idx", F.split("text", " ").alias("t"))
    count = lambda drop: F.size(F.filter("t", lambda x: ~x.isin(drop))).cast("long")
    return d.select("row_idx", F.size("t").cast("long").alias("n_all"), count(SPECIALS).alias("n_without_specials"), count(SPECIALS + FIELD_LABELS).alias("n_without_both"))


@query(f"""WITH t AS (SELECT item_id, i, toks[i + 1] AS token FROM (SELECT item_id, toks, unnest(range(len(toks))) AS i FROM (SELECT item_id, string_split(text, ' ') AS toks FROM benchmark))),
v AS (SELECT *, CASE WHEN token IN {tuple(SPECIALS + FIELD_LABELS)!r} THEN 0 ELSE 1 END AS valid FROM t),
w AS (SELECT *, sum(valid) OVER (PARTITION BY item_id ORDER BY i) - 1 AS o FROM v)
SELECT item_id, i AS index, token, CAST(valid AS INTEGER) AS valid, CAST(CASE WHEN valid = 1 AND o < 32 THEN o ELSE -1 END AS BIGINT) AS plot_index FROM w""")
def token_plot_index(spark, sf):
    # a running count in each item's order; its state is one number, however long the text
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "token"))
    b = b.withColumn("valid", F.when(F.col("token").isin(SPECIALS + FIELD_LABELS), 0).otherwise(1))
    place = F.sum("valid").over(Window.partitionBy("item_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - 1
    b = b.withColumn("place", place)
    return b.select("item_id", F.col("i").cast("long").alias("index"), "token", "valid", F.when((F.col("valid") == 1) & (F.col("place") < 32), F.col("place")).otherwise(-1).cast("long").alias("plot_index"))


@query(D + "SELECT row_idx, len(target) AS n_target, len(t) < 128 AS has_eos, len(t) > 128 AS truncated, list_last(target) AS last_token FROM (SELECT row_idx, t, CASE WHEN len(t) < 128 THEN list_append(t, '<eos>') ELSE list_slice(t, 1, 128) END AS target FROM (SELECT row_idx, string_split(text, ' ') AS t FROM doc))")
def target_truncation(spark, sf):
    d = doc(spark, sf).select("row_idx", F.split("text", " ").alias("t"))
    d = d.withColumn("target", F.when(F.size("t") < 128, F.concat("t", F.array(F.lit("<eos>")))).otherwise(F.slice("t", 1, 128)))
    return d.select("row_idx", F.size("target").cast("long").alias("n_target"), (F.size("t") < 128).alias("has_eos"), (F.size("t") > 128).alias("truncated"), F.element_at("target", -1).alias("last_token"))
