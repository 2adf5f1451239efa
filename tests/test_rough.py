"""Ranks from rough scores are those of exact ones: near and equal scores are settled exactly, and each query works out only what it returns."""

import numpy as np
import pytest

from pairforge.operators import maxsim, ranking, roundtrip
from pairforge.plans.catalog import QUERIES
from test_pairs import sides


def block(rng, n, p, d=16, scale=1.0):
    v = rng.standard_normal((n * p, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True) * scale, np.full(n, p)


def nothing(i, j):
    return np.zeros(len(i), bool)


@pytest.mark.parametrize("p, r, scale", [(4, 4, 1.0), (1, 3, 1.0), (2, 5, 300.0), (4, 4, 1e9)])
def test_counts_and_maxima_are_exact(p, r, scale):
    rng = np.random.default_rng(p)
    a, b = block(rng, 150, p, scale=scale), block(rng, 330, r)
    for k in range(0, 300, 3):  # copies, and vectors that single precision does not tell apart
        b[0][k * r : (k + 1) * r] = b[0][:r] + (k % 2) * 1e-8
    s, rough = np.round(maxsim._matrix(a, b), 9), maxsim.Rough(a, b)
    assert np.abs(rough.s - s).max() <= rough.slack and rough.s.dtype == (np.float32 if scale < 1e6 else np.float64)
    mask = rng.random(s.shape) < 0.1
    mask[5] = mask[:, 7] = False
    for axis in (0, 1):
        limit = rough.best(mask, axis)
        assert limit == pytest.approx(np.where(mask, s, -np.inf).max(axis), abs=2e-9 * scale)
        limit = s[0].copy() if axis == 0 else s[:, 0].copy()
        over = limit[None, :] if axis == 0 else limit[:, None]
        assert (rough.beyond(limit, axis, True, nothing) == (s >= over).sum(axis)).all()
        assert (rough.beyond(limit, axis, False, nothing) == (s > over).sum(axis)).all()
        assert (rough.beyond(np.full(len(limit), -np.inf), axis, True, nothing) == s.shape[axis]).all()


def test_uneven_and_odd_tokens_are_exact_from_the_start():
    a, b = (np.eye(3), np.array([1, 0, 2])), (np.eye(3)[:2], np.array([2]))
    rough = maxsim.Rough(a, b)
    assert not rough.plain and rough.exact(np.arange(3), np.zeros(3, int)).tolist() == maxsim._matrix(a, b)[:, 0].tolist()
    bad = maxsim.Rough((np.array([[np.nan, 1.0]]), np.array([1])), (np.eye(2), np.array([1, 1])))
    assert not bad.plain and (bad.beyond(np.array([0.0]), 1, True, nothing) == 0).all()


@pytest.fixture()
def seen(monkeypatch):
    """What `both_ranks` asks of the pairs: columns that blocks must agree in, and counts."""
    calls = []
    was = ranking.all_pairs
    monkeypatch.setattr(ranking, "all_pairs", lambda *a, **k: calls.append((k.get("near"), k.get("rough"))) or was(*a, **k))
    return calls


def test_rank_grouped_scores_roughly(spark, seen):
    QUERIES["rank_grouped"](spark, "/root/testdata/sf0.001")
    assert seen == [(("q", "c"), True), (("g", "g"), True), (None, True)]


def test_rank_ungrouped_makes_no_pass_over_groups(spark, seen):
    QUERIES["rank_ungrouped"](spark, "/root/testdata/sf0.001")
    assert seen == [(("q", "c"), True), (None, True)]


def test_retrieval_recall_scores_each_pair_once_for_both_sides(spark, seen):
    QUERIES["retrieval_recall"](spark, "/root/testdata/sf0.001")
    assert seen == [(("q", "c"), True), (("g", "g"), True), (None, True)]


def test_roundtrip_pairs_counts_one_rule(spark, monkeypatch):
    asked = []
    was = ranking.ranks
    monkeypatch.setattr(ranking, "ranks", lambda *a: asked.append(a[3:]) or was(*a))
    _, _, a, b = sides(spark)
    records = a.select("q", "tokens", "g").join(b.withColumnRenamed("tokens", "z_gen").drop("g"), a.q == b.c)
    roundtrip.pairs(records.selectExpr("q AS row_idx", "g AS uid", "tokens AS z_src", "z_gen", "'a' AS true_target", "'b' AS gen_target"))
    assert asked == [(("grouped",),)]


def test_one_rule_gives_what_both_give(spark):
    _, _, a, b = sides(spark)
    both = {r.q: r for r in ranking.ranks(a, b, "g").collect()}
    for rule in ranking.RULES:
        got = ranking.ranks(a, b, "g", (rule,))
        assert got.columns == ["q", "pos", "best_pos", rule]
        assert {r.q: (r.pos, r.best_pos, r[rule]) for r in got.collect()} == {q: (r.pos, r.best_pos, r[rule]) for q, r in both.items()}
