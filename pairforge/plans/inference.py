"""Queries over what models give: heads from a weight container, perplexities from masked passes, prompts without end."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from pairforge.functions.shared import rounded, shared_base
from pairforge.operators import encode, weights
from pairforge.plans.base import SEQ, TOK, events, query, table, with_
from pairforge.plans.sequences import EOS
from pairforge.plans.tokens import R
from pairforge.streaming import prompts

WIDTHS = (16, 12, 10, 8)


def fixed_head() -> encode.Head:
    """A head whose weights are simple functions of their places, so that SQL can state them."""
    layers = []
    for k, (a, b) in enumerate(zip(WIDTHS, WIDTHS[1:], strict=False)):
        i, j = np.arange(b)[:, None], np.arange(a)[None, :]
        layers.append(encode.Linear(((i * 7 + j * 13 + k * 5) % 11 - 5) / 10, ((np.arange(b) * 3 + k) % 7 - 3) / 10))
    scales = [1 + np.arange(w) % 3 / 10 for w in WIDTHS[1:3]]
    shifts = [(np.arange(w) % 5 - 2) / 20 for w in WIDTHS[1:3]]
    return encode.Head(layers, scales, shifts, (np.arange(WIDTHS[0]) % 4 - 1.5) / 100)


def _linear(k: int, x: str) -> str:
    a, b = WIDTHS[k], WIDTHS[k + 1]
    row = f"list_transform(range({a}), lambda j: ((i * 7 + j * 13 + {k * 5}) % 11 - 5) / 10.0::DOUBLE)"
    return f"list_transform(range({b}), lambda i: list_dot_product({x}, {row}) + ((i * 3 + {k}) % 7 - 3) / 10.0::DOUBLE)"


def _gelu(x: str) -> str:
    """By the series of the error function with positive terms, which 120 of them settle for these values."""
    y = f"({x} / sqrt(2.0::DOUBLE))"
    terms = f"list_reduce(list_prepend({{'t': {y}, 's': {y}}}, list_transform(range(1, 120), lambda n: {{'t': n::DOUBLE, 's': 0.0::DOUBLE}})), lambda a, n: {{'t': a.t * 2 * {y} * {y} / (2 * n.t + 1), 's': a.s + a.t * 2 * {y} * {y} / (2 * n.t + 1)}}).s"
    return f"0.5 * {x} * (1 + 2 / sqrt(pi()) * exp(-{y} * {y}) * {terms})"


def _layer_norm(x: str) -> str:
    centred = f"list_transform({x}, lambda v: v - list_avg({x}))"
    spread = f"sqrt(list_dot_product({centred}, {centred}) / len({x}) + 1e-5)"
    return f"list_transform(range(len({x})), lambda d: ({x}[d + 1] - list_avg({x})) / {spread} * (1 + d % 3 / 10.0::DOUBLE) + (d % 5 - 2) / 20.0::DOUBLE)"


HEAD = f"""h0 AS (SELECT vec_id, pos, list_transform(range(16), lambda d: r[d + 1] - (d % 4 - 1.5) / 100) AS x FROM slices),
a1 AS (SELECT vec_id, pos, {_linear(0, "x")} AS x FROM h0), g1 AS (SELECT vec_id, pos, list_transform(x, lambda v: {_gelu("v")}) AS x FROM a1), n1 AS (SELECT vec_id, pos, {_layer_norm("x")} AS x FROM g1),
a2 AS (SELECT vec_id, pos, {_linear(1, "x")} AS x FROM n1), g2 AS (SELECT vec_id, pos, list_transform(x, lambda v: {_gelu("v")}) AS x FROM a2), n2 AS (SELECT vec_id, pos, {_layer_norm("x")} AS x FROM g2),
z AS (SELECT vec_id, pos, {_linear(2, "x")} AS x FROM n2)"""


@query(with_(TOK, HEAD) + f"SELECT vec_id, pos, {R('x[1] / sqrt(list_dot_product(x, x))')} AS first, {R('x[8] / sqrt(list_dot_product(x, x))')} AS last FROM z")
def head_projection(spark, sf):
    """Tokens through a projection head whose weights every worker maps from one container file."""
    base = shared_base(spark)
    path = f"{base if ':' in base else 'file://' + base}/weights-{uuid.uuid4().hex}.safetensors"
    weights.save(path, weights.state({"text_proj": fixed_head()}) | {weights.SCALE: np.float64(math.log(20))})
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice("embedding", p * 16 + 1, 16)).alias("tokens"))
    z = weights.project(e, "tokens", path, "text_proj").select("vec_id", F.posexplode("z").alias("pos", "v"))
    return z.select("vec_id", "pos", rounded(F.element_at("v", 1)).alias("first"), rounded(F.element_at("v", 8)).alias("last"))


PASSES, TYPES = 3, 5
MASKED = f"""counts AS (SELECT seq, p, token <> '{EOS}' AS scored, count(*) OVER (PARTITION BY seq) AS n, count(*) OVER (PARTITION BY seq, token) AS same,
 count(*) FILTER (token <> '{EOS}') OVER (PARTITION BY seq, p % {PASSES}) AS hidden, count(*) FILTER (token <> '{EOS}') OVER (PARTITION BY seq, token, p % {PASSES}) AS same_hidden FROM ev),
masked AS (SELECT seq, count(*) FILTER (scored) AS n, exp(-avg(ln((same - same_hidden + 1) / (n - hidden + {TYPES}))) FILTER (scored)) AS pppl FROM counts GROUP BY seq)"""


@query(with_(SEQ, MASKED) + f"SELECT seq, n, {R('pppl')} AS pppl FROM masked")
def masked_passes(spark, sf):
    """Pseudo-perplexity of event sequences by three masked passes of a counting model; null where a sequence has nothing to score."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda x: x["token"])
    sequences = events(spark, sf).groupBy("seq").agg(ordered.alias("t"))
    found = encode.pseudo_perplexity(sequences, "seq", "t", lambda: encode.counting_scorer(TYPES), PASSES, specials=(EOS,))
    return found.select("seq", "n", F.when(~F.isnan("pppl"), rounded(F.col("pppl"))).alias("pppl"))


@query("SELECT epoch, doc_id, 1::BIGINT AS times, 1::BIGINT AS ranks FROM documents CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) e(epoch)")
def prompt_epochs(spark, sf):
    """Two epochs of prompts over three ranks: each holds every row of the table once, at one rank."""
    rows = prompts.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id")
    drawn = prompts.epochs(spark, rows.count(), 2, world=3, seed=5)
    return drawn.join(rows, "row_idx").groupBy("epoch", "doc_id").agg(F.count("*").alias("times"), F.countDistinct("rank").alias("ranks"))
