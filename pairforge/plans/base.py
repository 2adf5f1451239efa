"""Registration of queries, and the derivations of FIXTURES.md: pair rows, tokens, captions and sequences from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.vectors import l2_normalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its plain SQL."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("row_idx"), F.expr("cast(doc_id div 3 as string)").alias("uid"), F.concat("source", "lang").alias("protein"), "text")


DOC = "doc AS (SELECT doc_id AS row_idx, CAST(doc_id // 3 AS VARCHAR) AS uid, source || lang AS protein, text FROM documents)"

WIDTH, TOKENS = 16, 4


def tok(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, pos, r, v): raw and normalised tokens."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    e = e.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(TOKENS - 1))).alias("pos"), "e")
    return e.select("vec_id", "label", "pos", F.slice("e", F.col("pos") * WIDTH + 1, WIDTH).alias("r")).withColumn("v", l2_normalize(F.col("r")))


TOK = """slices AS (SELECT vec_id, label, pos, list_transform(list_slice(embedding, 16 * pos + 1, 16 * pos + 16), lambda x: CAST(x AS DOUBLE)) AS r
FROM (SELECT vec_id, label, embedding, CAST(unnest(range(4)) AS INTEGER) AS pos FROM embeddings)),
tok AS (SELECT vec_id, label, pos, r, list_transform(r, lambda x: x / greatest(sqrt(list_dot_product(r, r)), 1e-12)) AS v FROM slices)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, tokens): normalised tokens nested, in order."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda p: l2_normalize(F.slice("e", p * WIDTH + 1, WIDTH)))
    return e.select("vec_id", "label", cut.alias("tokens"))


def pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries (q, tokens, g) and candidates (c, tokens, g); g is the label of the query side of the pair."""
    it = items(spark, sf).withColumn("k", F.expr("vec_id div 2"))
    left = it.where("vec_id % 2 = 0").select(F.col("k").alias("q"), "tokens", F.col("label").alias("g"))
    labels = left.select(F.col("q").alias("c"), "g")
    right = it.where("vec_id % 2 = 1").select(F.col("k").alias("c"), "tokens").join(labels, "c").select("c", "tokens", "g")
    return left, right


PAIR = (
    TOK
    + """,
lt AS (SELECT vec_id // 2 AS q, label AS g, pos, v FROM tok WHERE vec_id % 2 = 0),
rt AS (SELECT t.vec_id // 2 AS c, l.g, t.pos, t.v FROM tok t JOIN (SELECT DISTINCT q, g FROM lt) l ON l.q = t.vec_id // 2 WHERE t.vec_id % 2 = 1),
cells AS (SELECT q, c, lt.g AS qg, rt.g AS cg, lt.pos AS i, rt.pos AS j, list_dot_product(lt.v, rt.v) AS s FROM lt CROSS JOIN rt),
scores AS (SELECT q, c, any_value(qg) AS qg, any_value(cg) AS cg, round(0.5 * (avg(m) FILTER (WHERE side = 0) + avg(m) FILTER (WHERE side = 1)), 9) AS score FROM (
  SELECT q, c, qg, cg, 0 AS side, i AS t, max(s) AS m FROM cells GROUP BY q, c, qg, cg, i UNION ALL
  SELECT q, c, qg, cg, 1, j, max(s) FROM cells GROUP BY q, c, qg, cg, j) GROUP BY q, c)"""
)

LABELS = ["NAME:", "TYPE:", "BRAND:"]


def captions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    text = F.concat(
        F.lit("NAME: "), "p_name", F.lit("."),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" TYPE: "), "p_type", F.lit("."))).otherwise(""),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit(" BRAND: "), "p_brand", F.lit("."))).otherwise(""),
    )
    return p.select(F.col("p_partkey").alias("row_idx"), (F.col("p_partkey") % 700).alias("uid"), F.when(F.col("p_partkey") % 10 < 9, 0).otherwise(1).alias("split"), text.alias("text"))


CAP = """cap AS (SELECT p_partkey AS row_idx, p_partkey % 700 AS uid, CASE WHEN p_partkey % 10 < 9 THEN 0 ELSE 1 END AS split,
'NAME: ' || p_name || '.' || CASE WHEN p_size % 3 <> 0 THEN ' TYPE: ' || p_type || '.' ELSE '' END || CASE WHEN p_size % 5 <> 0 THEN ' BRAND: ' || p_brand || '.' ELSE '' END AS text FROM part),
parts AS (SELECT row_idx, string_split(regexp_replace(text, '(^|\\s)(BRAND:|NAME:|TYPE:)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM cap),
pieces AS (SELECT row_idx, k, parts[k + 1] AS part, CAST(coalesce(list_sum(list_transform(list_slice(parts, 1, k), lambda x: length(x))), 0) AS BIGINT) AS begins
FROM (SELECT row_idx, parts, unnest(range(1, len(parts))) AS k FROM parts)),
labelled AS (SELECT row_idx, k - 1 AS fpos, CASE WHEN part LIKE 'NAME:%' THEN 0 WHEN part LIKE 'TYPE:%' THEN 1 ELSE 2 END AS label_id, part, begins, CASE WHEN part LIKE 'BRAND:%' THEN 6 ELSE 5 END AS size FROM pieces),
vals AS (SELECT *, substr(part, size + 1) AS rest FROM labelled),
trimmed AS (SELECT *, regexp_replace(rest, '^\\s+', '') AS tail, regexp_replace(regexp_replace(rest, '^\\s+', ''), '\\s+$', '') AS val FROM vals),
spans AS (SELECT row_idx, fpos, label_id, begins + size + length(rest) - length(tail) AS vs, begins + size + length(rest) - length(tail) + length(val) AS ve, val FROM trimmed WHERE length(val) > 0)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, p, token, logp): one sequence a user and day, p from 0."""
    e = table(spark, sf, "events").withColumn("seq", F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("event_type").alias("token"), (-F.col("value") / 100).alias("logp"))))
    each = e.groupBy("seq").agg(ordered.alias("t")).select("seq", F.posexplode("t").alias("p", "x"))
    return each.select("seq", "p", "x.token", "x.logp")


SEQ = """seqs AS (SELECT CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS seq, ts, event_id, event_type AS token, -value / 100 AS logp FROM events),
ev AS (SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY ts, event_id) - 1 AS INTEGER) AS p, token, logp FROM seqs)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
