"""Pairs of blocks meet without shuffling a block once for each partner."""

import numpy as np
import pytest

from pairforge.operators import maxsim
from pairforge.plans.catalog import QUERIES


def sides(spark, n=60, tokens=2):
    rng = np.random.default_rng(4)
    unit = lambda: [(x / np.linalg.norm(x)).tolist() for x in rng.standard_normal((tokens, 3))]
    left, right = ([(k, unit(), None if k % 7 == 0 else "ab"[k % 2]) for k in range(n)] for _ in range(2))
    return left, right, spark.createDataFrame(left, "q long, tokens array<array<double>>, g string"), spark.createDataFrame(right, "c long, tokens array<array<double>>, g string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_shuffled_for_each_partner(spark):
    left, right, a, b = sides(spark)
    s = maxsim.scores(a, b, block=4)
    assert "CartesianProduct" in plan(s) and "CoGroup" not in plan(s) and "Exchange" not in plan(s)
    got = {(r.q, r.c): r.score for r in s.collect()}
    assert len(got) == 3600
    for q, x, _ in left:
        for c, y, _ in right:
            m = np.array(x) @ np.array(y).T
            assert got[q, c] == pytest.approx(0.5 * (m.max(1).mean() + m.max(0).mean()), abs=1e-8)


def test_even_and_uneven_token_counts_agree():
    rng = np.random.default_rng(1)
    one, two = (rng.standard_normal((n, k, 5)) for n, k in ((131, 3), (517, 4)))
    even = maxsim.block_matrix(list(one), list(two))
    odd = maxsim.block_matrix([*one, one[0][:1]], [*two, two[0][:2]])
    assert np.allclose(even, odd[:-1, :-1])


@pytest.mark.parametrize("p, r", [(1, 1), (2, 3), (4, 4), (3, 8)])
def test_tiles_of_any_size_hold_the_scores(p, r):
    rng = np.random.default_rng(p)
    x, y = rng.standard_normal((13, p, 5)), rng.standard_normal((29, r, 5))
    s = np.einsum("apd,brd->abpr", x, y)
    want = 0.5 * (s.max(3).mean(2) + s.max(2).mean(2))
    for tile in ((64, 128), (4, 8), (13, 29), (5, 1)):
        assert np.allclose(maxsim._even(x.reshape(-1, 5), y.reshape(-1, 5), p, r, tile), want)
    tiles, (_, row), (_, column) = maxsim._Tiles(p, r, (4, 8), np.dtype(float)), maxsim._planes(x.reshape(-1, 5), p, 4)[1], maxsim._planes(y.reshape(-1, 5), r, 8)[2]
    assert np.allclose(tiles.score(row, column.transpose(0, 2, 1)), want[4:8, 16:24])


def test_every_score_is_rounded_once(spark):
    df = QUERIES["maxsim_matrix"](spark, "/root/testdata/sf0.001")
    assert "round(" not in plan(df).lower()
    s = [r.score for r in df.collect()]
    assert s == [round(v, 9) for v in s] and not any(v == 0 and str(v) == "-0.0" for v in s)
