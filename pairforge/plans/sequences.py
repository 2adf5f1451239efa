"""Queries over token sequences, strings and schedules."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairforge.functions import scalar
from pairforge.functions.shared import keyed_hash, rounded, shared_base, sql_hash
from pairforge.operators import ablation
from pairforge.plans.base import SEQ, events, query, table, with_
from pairforge.plans.tokens import R

EOS = "signup"
S = with_(SEQ)


@query(S + f"SELECT seq, p, token FROM (SELECT *, min(p) FILTER (WHERE token = '{EOS}') OVER (PARTITION BY seq) AS e FROM ev) WHERE e IS NULL OR p <= e")
def valid_until_eos(spark, sf):
    """Places up to and including the first end token; all places where there is none."""
    e = table(spark, sf, "events").withColumn("seq", F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    arr = e.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("t"))
    end = F.array_position("t", EOS)
    return arr.select("seq", F.posexplode(F.when(end > 0, F.slice("t", F.lit(1), end.cast("int"))).otherwise(F.col("t"))).alias("p", "token"))


@query(S + f"SELECT seq, count(*) AS n, coalesce(min(p) FILTER (WHERE token = '{EOS}'), count(*)) AS body FROM ev GROUP BY seq")
def body_length(spark, sf):
    """Tokens before the first end token, else all."""
    e = events(spark, sf)
    return e.groupBy("seq").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(F.col("token") == EOS, F.col("p"))).cast("long"), F.count("*")).alias("body"))


@query(S + f""", nxt AS (SELECT seq, p, lead(token) OVER (PARTITION BY seq ORDER BY p) AS target FROM ev),
logit AS (SELECT seq, token, count(*)::DOUBLE AS x FROM ev GROUP BY seq, token), lse AS (SELECT seq, max(x) + ln(sum(exp(x - m))) AS l FROM (SELECT *, max(x) OVER (PARTITION BY seq) AS m FROM logit) GROUP BY seq)
SELECT seq, p, target, {R('x - l')} AS logp FROM nxt JOIN logit g USING (seq) JOIN lse USING (seq) WHERE target IS NOT NULL AND g.token = target""")
def token_logprob(spark, sf):
    """Log softmax of the next token, with a sequence's token counts as logits."""
    e = events(spark, sf)
    w = Window.partitionBy("seq").orderBy("p")
    nxt = e.select("seq", "p", F.lead("token").over(w).alias("target")).where("target is not null")
    logit = e.groupBy("seq", "token").agg(F.count("*").cast("double").alias("x"))
    m = Window.partitionBy("seq")
    logit = logit.withColumn("m", F.max("x").over(m)).withColumn("l", F.col("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m"))).over(m)))
    return nxt.join(logit.withColumnRenamed("token", "target"), ["seq", "target"]).select("seq", "p", "target", rounded(F.col("x") - F.col("l")).alias("logp"))


@query(S + f", per AS (SELECT seq, sum(-logp) AS ce, count(*) AS n FROM ev GROUP BY seq) SELECT {R('sum(ce) / sum(n)')} AS token_weighted, {R('avg(ce / n)')} AS macro, {R('exp(sum(ce) / sum(n))')} AS perplexity FROM per")
def ce_weighted_vs_macro(spark, sf):
    per = events(spark, sf).groupBy("seq").agg(F.sum(-F.col("logp")).alias("ce"), F.count("*").alias("n"))
    weighted = F.sum("ce") / F.sum("n")
    return per.agg(rounded(weighted).alias("token_weighted"), rounded(F.avg(F.col("ce") / F.col("n"))).alias("macro"), rounded(F.exp(weighted)).alias("perplexity"))


GAINS = f"SELECT {R('off - shuffled')} AS presence, {R('shuffled - cond')} AS content, {R('off - cond')} AS total, {R('(off - shuffled) / (off - cond)')} AS presence_share, CASE WHEN abs(shuffled - cond) < 0.02 THEN 'none' WHEN abs(shuffled - cond) < 0.05 THEN 'weak' WHEN abs(shuffled - cond) < 0.15 THEN 'moderate' ELSE 'strong' END AS verdict"


@query(S + f", m AS (SELECT avg(value / 100) FILTER (WHERE event_id % 3 = 0) AS cond, avg(value / 100) FILTER (WHERE event_id % 3 = 1) AS shuffled, avg(value / 100) FILTER (WHERE event_id % 3 = 2) AS off FROM events) {GAINS} FROM m")
def ce_decomposition(spark, sf):
    """Gain from a memory's presence and from its content, from mean losses under three conditions."""
    condition = F.when(F.col("event_id") % 3 == 0, "conditioned").when(F.col("event_id") % 3 == 1, "shuffled").otherwise("off")
    e = table(spark, sf, "events").select(condition.alias("condition"), F.col("user_id").alias("seq"), (F.col("value") / 100).alias("loss"))
    d = ablation.decomposition(e)
    return d.select(*(rounded(F.col(c)).alias(c) for c in ("presence", "content", "total", "presence_share")), "verdict")


POLICY = "policy AS (SELECT seq, p, logp, logp * 0.9 - 0.01 AS ref, p % 4 <> 3 AS valid, avg(logp) OVER (PARTITION BY seq) AS adv FROM ev)"


@query(with_(SEQ, POLICY) + f"SELECT {R('-sum(adv * logp) / count(*)')} AS policy_loss, {R('avg(exp(ref - logp) - (ref - logp) - 1)')} AS kl, {R('avg(-logp)')} AS entropy FROM policy WHERE valid")
def policy_terms(spark, sf):
    e = events(spark, sf).withColumn("ref", F.col("logp") * 0.9 - 0.01).withColumn("adv", F.avg("logp").over(Window.partitionBy("seq"))).where("p % 4 <> 3")
    d = F.col("ref") - F.col("logp")
    return e.agg(rounded(-F.sum(F.col("adv") * F.col("logp")) / F.count("*")).alias("policy_loss"), rounded(F.avg(F.exp(d) - d - 1)).alias("kl"), rounded(F.avg(-F.col("logp"))).alias("entropy"))


PPPL = "pppl AS (SELECT seq, count(*) FILTER (WHERE p % 3 = 1) AS n, CASE WHEN count(*) FILTER (WHERE p % 3 = 1) = 0 THEN 'NaN'::DOUBLE ELSE exp(-avg(logp) FILTER (WHERE p % 3 = 1)) END AS pppl FROM ev GROUP BY seq)"


def pppl(spark, sf):
    scored = F.when(F.col("p") % 3 == 1, F.col("logp"))
    return events(spark, sf).groupBy("seq").agg(F.count(scored).alias("n"), F.coalesce(F.exp(-F.avg(scored)), F.lit(float("nan"))).alias("pppl"))


@query(with_(SEQ, PPPL) + f"SELECT seq, n, CASE WHEN n = 0 THEN NULL ELSE {R('pppl')} END AS pppl FROM pppl")
def pseudo_perplexity(spark, sf):
    """exp of the mean loss over the visited places; not a number, here shown as null, where none was visited."""
    return pppl(spark, sf).select("seq", "n", F.when(~F.isnan("pppl"), rounded(F.col("pppl"))).alias("pppl"))


@query(with_(SEQ, PPPL) + f"SELECT count(*) AS n_all, count(*) FILTER (WHERE NOT isnan(pppl)) AS n_scored, {R('avg(pppl) FILTER (WHERE NOT isnan(pppl))')} AS mean FROM pppl")
def nan_safe_mean(spark, sf):
    ok = ~F.isnan("pppl")
    return pppl(spark, sf).agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_scored"), rounded(F.avg(F.when(ok, F.col("pppl")))).alias("mean"))


@query()
def span_corruption(spark, sf):
    """Runs of tokens replaced by others of the alphabet, seeded by the sequence's name."""
    e = events(spark, sf)
    t = e.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda x: x["token"]).alias("t"))
    return t.select("seq", "t", scalar.span_corruption(0.3, ["click", "login", "purchase", "signup", "view"])("t", "seq").alias("corrupted"))


@query(S + f", n AS (SELECT seq, greatest(1, count(*))::DOUBLE AS a, greatest(1, count(*) FILTER (WHERE token <> 'click'))::DOUBLE AS b FROM ev GROUP BY seq) SELECT seq, {R('power(greatest(0, abs(ln(a / b)) - ln(1.1)), 2)')} AS penalty FROM n")
def length_band(spark, sf):
    n = events(spark, sf).groupBy("seq").agg(F.greatest(F.lit(1), F.count("*")).cast("double").alias("a"), F.greatest(F.lit(1), F.count_if(F.col("token") != "click")).cast("double").alias("b"))
    return n.select("seq", rounded(F.pow(F.greatest(F.lit(0.0), F.abs(F.log(F.col("a") / F.col("b"))) - F.log(F.lit(1.1))), F.lit(2.0))).alias("penalty"))


@query("SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'M' ELSE t END AS guarded FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '  ' END AS t FROM conversations)")
def empty_guard(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("  ").alias("t"))
    return c.select("conv_id", "turn", F.when(F.trim("t") == "", "M").otherwise(F.col("t")).alias("guarded"))


# strings


@query("SELECT item_id, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN '>true|' || item_id WHEN 1 THEN regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]', '', 'g') WHEN 2 THEN '>made|' || item_id ELSE regexp_replace(upper(reverse(replace(text, 'ß', 'ss'))), '[^A-Z]', '', 'g') END AS line FROM benchmark CROSS JOIN range(4) r(n)")
def fasta_lines(spark, sf):
    from pairforge.sources.sinks import fasta

    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("true"), F.reverse("text").alias("made"))
    return fasta(b, "item_id", {"true": "true", "made": "made"})


WS = "[ \\t\\n\\r]+"


@query(f"SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS rank, printf('%.4f', item_id / 7.0::DOUBLE) AS score, length(text) AS true_len, length(url) AS gen_len, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS true_target, trim(regexp_replace(url, '{WS}', ' ', 'g')) AS generated_target FROM benchmark JOIN pages ON page_id = item_id")
def pairs_report(spark, sf):
    from pairforge.functions.shared import positions

    both = table(spark, sf, "benchmark").join(table(spark, sf, "pages"), F.col("item_id") == F.col("page_id"))
    flat = lambda c: F.trim(F.regexp_replace(c, WS, " "))
    return positions(both, ["item_id"], name="rank").select(F.col("item_id").alias("id"), "rank", F.format_string("%.4f", F.col("item_id") / 7.0).alias("score"), F.length("text").cast("long").alias("true_len"), F.length("url").cast("long").alias("gen_len"), flat("text").alias("true_target"), flat("url").alias("generated_target"))


MARKED = "marked AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END || text AS raw FROM documents)"


@query(with_(MARKED) + ", s AS (SELECT doc_id, trim(raw) AS t FROM marked), m AS (SELECT doc_id, t, regexp_replace(t, '^[12]+', '') AS body FROM s) SELECT doc_id, CASE WHEN substr(t, 1, 1) = '2' THEN reverse(body) ELSE body END AS target FROM m")
def decode_target(spark, sf):
    """Direction markers stripped; reversed where the first is 2."""
    d = table(spark, sf, "documents").select("doc_id", F.trim(F.concat(F.when(F.col("doc_id") % 2 == 0, "1").otherwise("2"), F.col("text"))).alias("t"))
    body = F.regexp_replace("t", "^[12]+", "")
    return d.select("doc_id", F.when(F.substring("t", 1, 1) == "2", F.reverse(body)).otherwise(body).alias("target"))


@query(f"SELECT doc_id, CASE WHEN h % 2 = 0 THEN '1' || text ELSE '2' || reverse(text) END AS target FROM (SELECT *, {sql_hash('23', 'doc_id')} AS h FROM documents)")
def direction_augment(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", keyed_hash(23, F.col("doc_id")).alias("h"))
    return d.select("doc_id", F.when(F.col("h") % 2 == 0, F.concat(F.lit("1"), F.col("text"))).otherwise(F.concat(F.lit("2"), F.reverse("text"))).alias("target"))


# schedules and headers

WARM, TOTAL, BASE = 100, 1500, 3e-4
#: The step at which each record of a run's log was written.
STEP = "doc_id * 7 % 2003"


def steps(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(STEP).alias("s"))


def cosine_rate(step, base: float, warm: int, total: int):
    """A straight rise over `warm` steps, then half a cosine down to nothing at `total`."""
    return F.when(step < warm, base * (step + 1) / warm).otherwise(base * 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), (step - warm) / float(total - warm)))))


def ramp(step, weight: float, start: int, rise: int):
    """Nothing before `start`, then a straight rise over `rise` steps, at once where there are none."""
    return F.when(step < start, 0.0).otherwise(weight * F.least(F.lit(1.0), (step - start) / float(rise)) if rise else F.lit(weight))


@query(f"SELECT doc_id, s AS step, round(CASE WHEN s < {WARM} THEN {BASE} * (s + 1) / {WARM} ELSE {BASE} * 0.5 * (1 + cos(pi() * least(1.0, (s - {WARM})::DOUBLE / {TOTAL - WARM}))) END, 12) AS lr FROM (SELECT doc_id, {STEP} AS s FROM documents)")
def lr_schedule(spark, sf):
    """The rate at which each logged step of a run was made."""
    return steps(spark, sf).select("doc_id", F.col("s").alias("step"), F.round(cosine_rate(F.col("s"), BASE, WARM, TOTAL), 12).alias("lr"))


@query(f"SELECT doc_id, s AS step, {R('CASE WHEN s < 300 THEN 0.0 ELSE 0.7 * least(1.0, (s - 300)::DOUBLE / 600) END')} AS weight, {R('CASE WHEN s < 300 THEN 0.0 ELSE 0.7 END')} AS at_once FROM (SELECT doc_id, {STEP} AS s FROM documents)")
def decoy_ramp(spark, sf):
    """Zero, then a straight rise, then the weight; at once where the rise takes no time."""
    s = F.col("s")
    return steps(spark, sf).select("doc_id", s.alias("step"), rounded(ramp(s, 0.7, 300, 600)).alias("weight"), rounded(ramp(s, 0.7, 300, 0)).alias("at_once"))


#: Settings of one run a language and source: a label list in some order, a length, a type that some lack.
RUN_SQL = """runs AS (SELECT coalesce(lang, '') || '|' || coalesce(source, '') AS name, CASE WHEN min(doc_id) % 4 = 3 THEN NULL WHEN max(doc_id) % 3 = 0 THEN 512 ELSE 1024 END AS max_len, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE 'bf16' END AS dtype,
CASE count(*) % 3 WHEN 0 THEN 'B:,A:' WHEN 1 THEN 'A:,B:' ELSE 'A:' END AS labels FROM documents GROUP BY 1)"""


def runs(spark, sf):
    """(name, max_len, dtype, labels): the settings that stores of several runs were made with, saved beside each and read again."""
    n, first, last = F.count("*"), F.min("doc_id"), F.max("doc_id")
    name = F.concat_ws("|", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    made = table(spark, sf, "documents").groupBy(name.alias("name")).agg(
        F.when(first % 4 == 3, F.lit(None)).when(last % 3 == 0, F.lit(512)).otherwise(F.lit(1024)).cast("long").alias("max_len"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(F.lit("bf16")).alias("dtype"),
        F.when(n % 3 == 0, "B:,A:").when(n % 3 == 1, "A:,B:").otherwise("A:").alias("labels"),
    )
    path = f"{shared_base(spark)}/runs-{uuid.uuid4().hex}"
    made.write.json(path)
    return spark.read.schema("name string, max_len long, dtype string, labels string").json(path)


@query(with_(RUN_SQL) + "SELECT name, coalesce(max_len = 1024, FALSE) AND coalesce(dtype = 'bf16', FALSE) AND coalesce(list_sort(string_split(labels, ',')) = ['A:', 'B:'], FALSE) AS matches FROM runs")
def fingerprint_match(spark, sf):
    """Every expected field must be there and equal; label lists match in any order."""
    mine = F.struct("max_len", "dtype", F.array_sort(F.split("labels", ",")).alias("labels"))
    want = F.struct(F.lit(1024).cast("long").alias("max_len"), F.lit("bf16").alias("dtype"), F.array(F.lit("A:"), F.lit("B:")).alias("labels"))
    return runs(spark, sf).select("name", mine.eqNullSafe(want).alias("matches"))


@query(with_(RUN_SQL) + "SELECT name, array_to_string(list_filter([CASE WHEN dtype IS DISTINCT FROM 'bf16' THEN 'dtype' END, CASE WHEN labels IS DISTINCT FROM 'A:,B:' THEN 'labels' END, CASE WHEN max_len IS DISTINCT FROM 1024 THEN 'max_len' END], lambda x: x IS NOT NULL), ',') AS differing FROM runs")
def config_diff(spark, sf):
    """Names of the fields that differ, in order."""
    have = F.create_map(F.lit("max_len"), F.col("max_len").cast("string"), F.lit("dtype"), "dtype", F.lit("labels"), "labels")
    want = F.create_map(F.lit("max_len"), F.lit("1024"), F.lit("dtype"), F.lit("bf16"), F.lit("labels"), F.lit("A:,B:"))
    diff = F.map_filter(F.map_zip_with(have, want, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, v: v)
    return runs(spark, sf).select("name", F.array_join(F.array_sort(F.map_keys(diff)), ",").alias("differing"))
