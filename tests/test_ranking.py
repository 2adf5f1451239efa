import math

import numpy as np
import pytest

from pairforge.operators import quantiles, ranking

ODD = [0.0, -0.0, 1e300, -1e300, 1.7e308, -1.7e308, 5e-324, 1.0, 1.0 + 2**-52, 1.0, 1.0, float("inf"), float("-inf"), float("nan"), None, 3.25]


@pytest.mark.parametrize("bins", [2, 16, 256])
def test_order_statistics_of_odd_values(spark, bins):
    df = spark.createDataFrame([(x,) for x in ODD], "x double").repartition(3)
    want = sorted(x for x in ODD if x is not None and not math.isnan(x))
    got = quantiles.order_statistics(df, "x", list(range(len(want))), bins)
    assert [got[k] for k in range(len(want))] == want
    with pytest.raises(ValueError):
        quantiles.order_statistics(df, "x", [len(want)])


def test_quantiles_as_numpy_gives_them(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal(3000) ** 5, np.full(700, 0.5), np.exp(rng.uniform(-300, 300, 300))])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    shares = [0.0, 0.001, 0.1, 0.5, 0.77, 0.9, 1.0]
    for rule, method in (("interpolated", "linear"), ("lower", "lower"), ("higher", "higher")):
        assert quantiles.quantiles(df, "x", shares, rule, 32) == pytest.approx(np.quantile(x, shares, method=method).tolist(), rel=1e-12)
    assert quantiles.quantiles(df.where("x > 1e300"), "x", [0.5]) == [None]
    assert quantiles.quantiles(spark.createDataFrame([(3,), (1,), (2,), (9,)], "x long"), "x", [0.5], "lower") == [2.0]


@pytest.mark.parametrize("bins", [1, 8, 256])
def test_average_precision_of_a_large_group(spark, bins):
    """One group holds most of 5,000 candidates, others are few; scores tie often; no row holds a query's scores."""
    rng = np.random.default_rng(bins)
    wide = rng.standard_normal((5000, 3))
    wide[::3] = wide[0]
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    group = np.where(rng.random(5000) < 0.9, 0, rng.integers(1, 40, 5000))
    right = [(c, [unit(v)], int(g)) for c, (v, g) in enumerate(zip(wide, group, strict=True))]
    left = [(q, [unit(rng.standard_normal(3))], int(group[q])) for q in range(24)] + [(9000, [unit(wide[1])], 99)]
    a = spark.createDataFrame(left, "q long, tokens array<array<double>>, g int")
    b = spark.createDataFrame(right, "c long, tokens array<array<double>>, g int")
    got = {r.q: r.ap for r in ranking.average_precisions(a, b, "g", bins).collect()}
    y = np.array([r[1][0] for r in right])
    for q, x, g in left:
        s = np.round(y @ np.array(x[0]), 9)
        order = np.lexsort((np.arange(5000), -s))
        good = (group[order] == g) | (order == q)
        at = np.flatnonzero(good) + 1
        assert got[q] == pytest.approx(float((np.arange(1, len(at) + 1) / at).sum() / max(1, len(at))), abs=1e-9)


@pytest.mark.parametrize("block", [512, 7])
def test_ranks_of_both_sides_by_loops(spark, monkeypatch, block):
    """Own pairs and groups meet in blocks of their own; queries without an own candidate, lone groups, ties, items without tokens."""
    from pairforge.operators import maxsim

    monkeypatch.setattr(maxsim.all_pairs, "__defaults__", (block, None))
    rng = np.random.default_rng(6)
    e = np.eye(4).tolist()
    tokens = lambda: [e[int(rng.integers(4))] for _ in range(int(rng.integers(0, 3)))]
    left = [(k, tokens(), int(rng.integers(5))) for k in range(30)]
    right = [(k, tokens(), left[k][2] if k < 30 else 77) for k in range(3, 33)]
    a = spark.createDataFrame(left, "q long, tokens array<array<double>>, g int")
    b = spark.createDataFrame(right, "c long, tokens array<array<double>>, g int")
    s = np.round(maxsim.block_matrix([x[1] for x in left], [y[1] for y in right]), 9)
    for relevant in ("g", None):
        got = {(r.side, r.id): (r.pos, r.best_pos, r.ungrouped, r.grouped) for r in ranking.both_ranks(a, b, relevant).collect()}
        assert len(got) == 60
        for side, mine, other, scores in ((0, left, right, s), (1, right, left, s.T)):
            for i, x in enumerate(mine):
                own = [scores[i, j] for j, y in enumerate(other) if y[0] == x[0]]
                good = [y[0] == x[0] or relevant == "g" and y[2] == x[2] for y in other]
                pos = own[0] if own else -math.inf
                best = max([v for v, g in zip(scores[i], good, strict=True) if g], default=-math.inf)
                want = (pos, best, sum(v >= pos for v in scores[i]), 1 + sum(v > best for v, g in zip(scores[i], good, strict=True) if not g))
                assert got[side, x[0]] == want
        forward = {r.q: (r.pos, r.best_pos, r.ungrouped, r.grouped) for r in ranking.ranks(a, b, relevant).collect()}
        assert forward == {i: v for (k, i), v in got.items() if k == 0}
